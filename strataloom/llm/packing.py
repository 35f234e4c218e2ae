"""Packing of token sequences: shortest-pack-first over the length histogram.

Each document's token stream is cut at multiples of the sequence length; whole pieces fill a sequence of their own, the
remainders are packed. Only the histogram of remainder lengths (at most ``seq_len`` rows) reaches the driver; there,
lengths are placed longest first, each into the pack with the most room left, while packing *patterns* carry counts, so
the work depends on the number of different lengths and not on the number of documents. Patterns go back to the
documents by rank: the r-th piece of a length takes the r-th place that the patterns have for that length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .word_cache import Memo
from .words import give_back

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SALTS = 256
FEW_PLACES = 4_000_000

_ENCODERS: dict = {}


class WordEncoder:
    """Token ids of whole texts as little-endian uint32 bytes, by memoised pieces between blanks.

    The tokenizer's pre-tokenizer never joins characters across white space, so text cut at blanks and line feeds
    encodes piece by piece. Words of letters with plain marks behind them are looked up apart from their marks, unless
    composition or lower-casing could join or move characters between the two.
    """

    WORD = regex.compile(r"(\p{L}+)([^\s\p{L}\p{N}'<]+)")
    #: Characters whose lower-casing or composition could depend on their neighbours, or make more of one; texts with them skip the early lower-casing, units with them the split.
    FAR = regex.compile("[İƀ-\U0010ffff]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.memo = Memo(self._encode, 900_000)

    def _encode(self, unit: str) -> bytes:
        if not unit:
            return b""
        if (m := self.WORD.fullmatch(unit)) and not self.FAR.search(unit):
            return self.memo[m[1]] + self.memo[m[2]]
        return np.asarray(self.tok.encode(unit, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not self.FAR.search(text) and "<|" not in text:
            text = text.lower()
        elif "<|" in text:  # the special tokens' own strings: left to the tokenizer as a whole
            return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        out = b"".join(map(self.memo.__getitem__, text.replace("\n", " ").split(" ")))
        self.memo.trim()
        return out


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece of each document's ids followed by ``end_id``; a null text is an empty one."""

    def run(batches):
        enc = encoder(tokenizer_path)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            cols = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                blob = enc.ids(text or "") + end
                n = len(blob) // 4
                for start in range(0, n, seq_len):
                    part = blob[4 * start : 4 * (start + seq_len)]
                    for c, v in zip(cols, (doc_id, start, len(part) // 4, zlib.crc32(part), n)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, PIECES)


def shortest_pack_first(histogram: dict[int, int], seq_len: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (count, lengths) that hold every length of the histogram: longest first, into the shortest pack so far.

    Packs of equal content are one pattern with a count. A run of ``c`` pieces of one length meets the patterns with
    the most room; if there are fewer such packs than pieces, all of them grow and the rest goes on to the next.
    """
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))  # room left -> pattern -> count
    closed: list[tuple[int, tuple[int, ...]]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(open_, default=0)
            if room < length:
                k = max(1, seq_len // length)  # new packs: so many of this length fit
                full, rest = divmod(left, k)
                for count, items in ((full, k), (1 if rest else 0, rest)):
                    if count:
                        open_[seq_len - items * length][(length,) * items] += count
                left = 0
                break
            pattern, count = open_[room].popitem()
            used = min(count, left)
            if count > used:
                open_[room][pattern] = count - used
            if not open_[room]:
                del open_[room]
            space = room - length
            if space:
                open_[space][(*pattern, length)] += used
            else:
                closed.append((used, (*pattern, length)))
            left -= used
        if 0 in open_:
            closed += [(c, p) for p, c in open_.pop(0).items()]
    closed += [(c, p) for patterns in open_.values() for p, c in patterns.items()]
    return sorted(closed, key=lambda x: (x[1], x[0]), reverse=True)


def pack(parts: DataFrame, seq_len: int = 2048) -> DataFrame:
    """Give every piece its ``sequence_id`` and ``offset``; sequences are numbered from 0 without gaps.

    ``parts`` is read several times: pass a written table. Ties (equal lengths) go by doc_id, then start; repeated rows
    are pieces of their own. No rows in, no rows out.
    """
    spark = parts.sparkSession
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most seq_len rows
    slots, base = [], 0
    taken: dict[int, int] = defaultdict(int)
    for count, pattern in shortest_pack_first(histogram, seq_len):
        offset = 0
        for length in pattern:
            slots.append((length, taken[length], taken[length] + count, base, offset))
            taken[length] += count
            offset += length
        base += count
    # The patterns' places: a pattern grows by one piece a step, so their number is bounded by lengths and pieces of a
    # sequence, not by rows; beyond the bound in bytes (40 a place) they are joined by a shuffle.
    places = spark.createDataFrame(slots, "length long, lo long, hi long, base long, offset long")
    places = F.broadcast(places) if len(slots) <= FEW_PLACES else places
    before = counts.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = F.broadcast(before.select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before")))  # at most seq_len * SALTS rows of 20 bytes: 10 MB
    ranked = salted.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "start")))
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_r") - 1)
    joined = ranked.join(places, (ranked["length"] == places["length"]) & (ranked["_rank"] >= places["lo"]) & (ranked["_rank"] < places["hi"])).drop(places["length"])
    return joined.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("_rank") - F.col("lo")).alias("sequence_id"), "offset")
