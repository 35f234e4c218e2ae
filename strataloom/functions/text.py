"""Text expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the index leaves out.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would "
    "could should may might must shall can need this that these those it its if else elif then than so such no not only own same "
    "def class return import self none true false pass break continue try except finally raise assert yield lambda global local"
).split()


def _pieces(text: Column) -> Column:
    return F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z])([A-Z])", "$1 $2")), r"[^\p{L}\p{N}]+")


def _wanted(tokens: Column, least: int) -> Column:
    return F.filter(tokens, lambda t: (F.length(t) >= least) & (F.translate(t, "0123456789", "") != "") & ~t.isin(STOP_WORDS))


def index_tokens(text: Column, least: int = 2) -> Column:
    """Lower-case tokens: cut at camel humps, underscores and punctuation; without numbers, stop words and short ones. Null gives none."""
    return _wanted(_pieces(text), least)


def different_tokens(text: Column, least: int = 2) -> Column:
    """Each of the tokens once."""
    return _wanted(F.array_distinct(_pieces(text)), least)


def normalized(text: Column) -> Column:
    """Lower case, punctuation dropped, white space runs as one blank, trimmed."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_ \t\n\r\f]", "")
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r\f]+", " "))


def word_set(text: Column) -> Column:
    """Different words of the normalized text."""
    return F.array_distinct(words(text))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of different elements; two empty ones are alike (1), one empty one is not (0)."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, floored."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)


def words(text: Column) -> Column:
    """Words of the normalized text in order."""
    return F.filter(F.split(normalized(text), " "), lambda t: t != "")


def word_shingles(w: Column, k: int) -> Column:
    """Different runs of ``k`` of the words in a column, joined by blanks (none if there are fewer words)."""
    n = F.size(w)
    return F.when(n >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(w, i, k), " ")))).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Trimmed sentences: cut behind ``.``, ``!`` or ``?`` where white space and a capital follow."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+(?=[A-Z])")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def sentence_chunks(text: Column, size: int = 1000, overlap: int = 0) -> Column:
    """Chunks of whole sentences of about ``size`` characters; each further one starts with the ``overlap`` last characters of the one before."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def step(acc: Column, s: Column) -> Column:
        full = (acc["now"] != "") & (F.length(acc["now"]) + F.length(s) > size)
        tail = F.concat(F.substring(acc["now"], F.greatest(F.length(acc["now"]) - overlap + 1, F.lit(1)), F.lit(overlap)), F.lit(" "), s) if overlap else s
        fresh = F.struct(F.concat(acc["out"], F.array(F.trim(acc["now"]))).alias("out"), tail.alias("now"))
        more = F.struct(acc["out"].alias("out"), F.when(acc["now"] == "", s).otherwise(F.concat(acc["now"], F.lit(" "), s)).alias("now"))
        return F.when(full, fresh).otherwise(more)

    return F.aggregate(sentences(text), empty, step, lambda acc: F.when(F.trim(acc["now"]) != "", F.concat(acc["out"], F.array(F.trim(acc["now"])))).otherwise(acc["out"]))
