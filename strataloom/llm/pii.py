"""Personal data in whole texts, with DataFrame and SQL functions only.

High-recall generators propose spans by pattern: the base kinds (email, ip, card, phone) and wider ones (local
phone numbers, social security numbers, bank account numbers), which may overlap. Boosted trees score every proposed
span from its format and context; a wider span is kept if its score reaches the threshold that was calibrated for its
kind and it overlaps no base span. The trees (``pii_model.json``, grown by ``pii_train.py`` on labelled text made by rule)
are plain CASE expressions here.
"""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
WIDE = ("local_phone", "ssn", "iban")
KINDS = BASE + WIDE
#: Generators. Possessive forms of the base patterns: they match the same spans and need no retries or recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?=[0-9][ -]?[0-9])[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
}
#: A cheap necessary condition of each generator.
GATES = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
CONTEXT = 40
#: Words before a span that speak for a kind, or for none, in English, German, French and Spanish (parts of words, lower case).
CUES = {
    "phone": ("phone", "call", "tel", "mobil", "fax", "cell", "dial", "ruf", "handy", "nummer", "appel", "portable", "num\u00e9ro", "llam", "m\u00f3vil", "n\u00famero", "numero"),
    "id": ("ssn", "social", "security", "taxpayer", "sozialversicherung", "steuer", "ausweis", "sociale", "fiscal", "seguro", "identi", "dni", "nif"),
    "bank": ("iban", "bank", "account", "transfer", "konto", "\u00fcberweis", "virement", "compte", "banque", "cuenta", "banco"),
    "other": ("order", "ticket", "version", "part", "serial", "model", "invoice", "item", "build", "sku", "bestell", "rechnung", "artikel", "teile", "serie", "commande", "facture", "r\u00e9f\u00e9rence", "article", "pedido", "factura", "art\u00edculo", "referencia", "lote"),
}
FEATURES = ("is_phone", "is_ssn", "is_iban", "length", "digits", "separators", "repeats", "area", "mod97", "cue_phone", "cue_id", "cue_bank", "cue_other", "slash_before", "unit_after")
MODEL = Path(__file__).with_name("pii_model.json")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == 1
        return acc + F.when(twice & (d > 4), 2 * d - 9).when(twice, 2 * d).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    """What a base match must meet besides its pattern."""
    if kind == "ip":
        plain = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(hit, "\\."), lambda p: (F.length(plain(p)) < 3) | ((F.length(plain(p)) == 3) & (plain(p) <= "255")))
    n = F.length(_digits(hit))
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), _luhn(_digits(hit))).otherwise(False)
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def matches(text: Column, kind: str) -> Column:
    """Array of (start, end, hit) of a kind's matches, in code points: from the pieces between them and their own lengths."""
    pieces, hits = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["hit"])
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), x["hit"].alias("hit"))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    zipped = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, h: F.struct(p.alias("piece"), h.alias("hit")))
    found = F.when(F.size(hits) > 0, F.aggregate(zipped, empty, step, lambda acc: acc["out"]))
    if kind in GATES:
        found = F.when(F.contains(text, F.lit(GATES[kind])), found)
    elif kind in ("card", "local_phone"):
        found = F.when(F.rlike(text, F.lit("[0-9]{2}" if kind == "local_phone" else "[0-9][ -]?[0-9]")), found)
    return F.coalesce(found, F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>"))


def features(kind: str, hit: Column, before: Column, after: Column) -> dict[str, Column]:
    """Format and context of a proposed span, as numbers."""
    digits = _digits(hit)
    compact = F.regexp_replace(hit, " ", "")
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)

    def rest(acc: Column, i: Column) -> Column:
        v = value(F.substring(turned, i, F.lit(1)))
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

    mod97 = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), rest) if kind == "iban" else F.lit(-1)
    low = F.lower(before)
    cue = lambda p: low.rlike(p).cast("double")
    return {
        **{f"is_{k.split('_')[-1]}": F.lit(float(k == kind)) for k in WIDE},
        "length": F.length(hit).cast("double"),
        "digits": F.length(digits).cast("double"),
        "separators": F.length(F.regexp_replace(hit, "[^ ().-]", "")).cast("double"),
        "repeats": F.length(F.regexp_replace(digits, "([0-9])(?=[0-9]*\\1)", "")).cast("double"),
        "area": F.coalesce(F.substring(digits, 1, 3).cast("double"), F.lit(-1.0)),
        "mod97": (mod97 == 1).cast("double"),
        **{f"cue_{k}": cue("|".join(w)) for k, w in CUES.items()},
        "slash_before": F.rlike(before, F.lit("[/#=_:]$")).cast("double"),
        "unit_after": F.rlike(after, F.lit("^ ?(?:units?|pcs|kg|px|ms|bytes?|%)")).cast("double"),
    }


def score(model: dict, x: dict[str, Column]) -> Column:
    """Probability by the trees, as CASE expressions."""

    def walk(i: int) -> Column:
        f = model["feature"][i]
        if f < 0:
            return F.lit(float(model["value"][i]))
        return F.when(x[FEATURES[f]] > F.lit(float(model["threshold"][i])), walk(model["left"][i] + 1)).otherwise(walk(model["left"][i]))

    margin = reduce(lambda a, b: a + b, [walk(r) for r in model["roots"]], F.lit(float(model["bias"])))
    return 1 / (1 + F.exp(-margin))


def around(text: Column, span: Column) -> tuple[Column, Column]:
    first = F.greatest(span["start"] - CONTEXT, F.lit(0)).cast("int")
    return F.substring(text, first + 1, span["start"].cast("int") - first), F.substring(text, span["end"].cast("int") + 1, F.lit(CONTEXT))


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii``: array of (kind, start, end), base spans by kind as listed and start, then the others alike.

    Code points, end exclusive. All columns of ``docs`` are kept (one named pii is replaced). A null text has none. Every
    row is handled on its own, so repeated rows and ties need no rule; an empty table gives an empty result. A very long text
    is one row in one task; its list of matches is copied for each match, so thousands of them in one text are slow.
    """
    model = json.loads(MODEL.read_text())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keep = [F.col(f"`{c}`") for c in docs.columns if c != "pii"]
    rows = docs.select(F.struct(*keep).alias("_row"), text.alias("_text"))
    # Texts without digits and "@" are done at once; the patterns run on the others only.
    likely = F.rlike("_text", F.lit("[0-9@]"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>")
    rows = rows.select("_row", "_text", *[F.when(likely, matches(F.col("_text"), k)).otherwise(none).alias(f"_{k}") for k in KINDS])
    shape = lambda k: lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    valid = lambda k: lambda s: _valid(k, s["hit"])
    base = F.concat(*[F.transform(F.filter(f"_{k}", valid(k)), shape(k)) for k in BASE])
    rows = rows.withColumn("_base", base)

    def kept(k: str):
        def test(s: Column) -> Column:
            before, after = around(F.col("_text"), s)
            free = ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
            return F.when(free, score(model, features(k, s["hit"], before, after)) >= F.lit(float(model["cut"][k]))).otherwise(False)

        return test

    wide = [F.transform(F.filter(f"_{k}", kept(k)), shape(k)) for k in WIDE]
    return rows.select("_row.*", F.concat("_base", *wide).alias("pii"))


def redact_pii(docs: DataFrame) -> DataFrame:
    """``find_pii`` with the spans of ``text`` replaced by a mark of their kind in ``redacted_text`` (overlaps: the first)."""
    found = find_pii(docs)
    spans = F.array_sort("pii", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        cut = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], cut, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(new)

    text = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    return found.withColumn("redacted_text", F.when(F.size("pii") > 0, text).otherwise(F.coalesce("text", F.lit(""))))
