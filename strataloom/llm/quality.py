"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text are numbers that do not depend on its language. Trees are grown on binned statistics of a
bounded labelled sample and flattened into arrays, which tasks walk for a batch of rows at a time. All texts are read once
more, to be scored; nothing of them is written in between.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import give_back

#: Bound on the labelled rows that the model is fitted on (a hash sample of them where there are more).
MAX_TRAIN = 20_000
FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "letters", "upper", "digits", "blanks", "marks", "symbols", "high_bytes",
    "distinct_words", "top_word", "word_pairs", "lines", "line_length", "distinct_lines", "compressed", "title_words", "end_marks", "bars", "runs",
)

_CLASS = np.zeros(256, dtype=np.int64)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"()?-", b"!#$%&*+/<=>@[\\]^_`{|}~"), start=1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 7


def statistics(text: str) -> list[float]:
    """The text's statistics, in the order of FEATURES; all defined for an empty text."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    c = np.bincount(_CLASS, weights=hist, minlength=8) / max(n, 1)
    words = raw.split()
    w = len(words)
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:]))) / (w - 1) if w > 1 else 1.0
    squeezed = len(zlib.compress(raw, 1)) / n if n else 1.0
    titles = sum(x[:1].isupper() for x in words) / max(w, 1)
    ends = sum(x[-1:] in b".?!" for x in words) / max(w, 1)
    return [
        math.log1p(n), math.log1p(w), sum(map(len, words)) / max(w, 1), math.log1p(max(map(len, words), default=0)), c[1] + c[2] + c[7], c[2] / max(c[1] + c[2], 1e-9) if n else 0.0, c[3], c[4], c[5], c[6], c[7],
        len(counts) / max(w, 1), max(counts.values(), default=0) / max(w, 1), pairs, math.log1p(len(lines)), n / max(len(lines), 1), len(set(lines)) / max(len(lines), 1), squeezed, titles, ends, hist[124] / max(w, 1), hist[33] / max(w, 1),
    ]


class Trees:
    """Boosted trees as flat arrays: for node i, feature, threshold, left child (right is next to it), value; roots by tree."""

    def __init__(self, bias: float, roots, feature, threshold, left, value, depth: int):
        self.bias, self.depth = bias, depth
        self.roots, self.feature, self.threshold, self.left, self.value = (np.asarray(x) for x in (roots, feature, threshold, left, value))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches: all rows go down one level at a time."""
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                node = np.where(f < 0, node, self.left[node] + (x[rows, np.maximum(f, 0)] > self.threshold[node]))
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64, least: float = 4.0, ridge: float = 1.0) -> Trees:
    """Histogram gradient boosting of the logistic loss: gradients are summed by bin, the best split of each node taken."""
    n, m = x.shape if x.size else (0, len(FEATURES))
    if not n or y.min() == y.max():
        p = (y.sum() + 1) / (n + 2) if n else 0.5
        return Trees(float(np.log(p / (1 - p))), np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int), np.zeros(0), 0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    shifted = binned + np.arange(m) * bins
    p = y.mean()
    bias = float(np.log(p / (1 - p)))
    margin = np.full(n, bias)
    roots, feature, threshold, left, value = [], [], [], [], []

    def new() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        roots.append(new())
        level = [(roots[-1], np.arange(n))]
        for d in range(depth + 1):
            below = []
            for node, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = float(-rate * gs / (hs + ridge))
                if d == depth or len(rows) < 2 * least:
                    margin[rows] += value[node]
                    continue
                flat = shifted[rows].ravel()
                hist = [np.bincount(flat, weights=np.repeat(v[rows], m), minlength=m * bins).reshape(m, bins).cumsum(axis=1)[:, :-1] for v in (g, h, np.ones(n))]
                gl, hl, nl = hist
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                j, b = divmod(int(gain.argmax()), bins - 1)
                if gain[j, b] <= 1e-6 or b >= len(cuts[j]):
                    margin[rows] += value[node]
                    continue
                feature[node], threshold[node] = j, float(cuts[j][b])
                left[node] = new()
                new()
                go = binned[rows, j] > b
                below += [(left[node], rows[~go]), (left[node] + 1, rows[go])]
            level = below
    return Trees(bias, roots, feature, threshold, left, value, depth)


def _matrix(texts: pa.Array) -> np.ndarray:
    """Statistics of each text; texts are unpacked one at a time."""
    return np.asarray([statistics(t.as_py() or "") for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


def _measure(batches):
    for batch in batches:
        x = _matrix(batch.column(2))
        stats = pa.ListArray.from_arrays(pa.array(range(0, x.size + 1, len(FEATURES)), pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), stats], names=["doc_id", "y", "stats"])


def held_out(doc_id):
    """Rows that no label is learnt from: crc32 of the id as text, modulo 3, is 1 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    """Trees from the texts (``doc_id``, ``text``) of at most about ``max_train`` labelled rows not held out.

    The sample of labels is bounded, so it may be broadcast to the documents: only sampled texts are measured for it.
    """
    y = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    y = y.where(~held_out("doc_id"))
    share = min(1.0, max_train / max(y.count(), 1))
    y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**62)) < int(share * 2**62))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(y), "doc_id").select("doc_id", "y", "text")
    got = rows.mapInArrow(_measure, "doc_id long, y double, stats array<double>").orderBy("doc_id", "stats").toPandas()
    x = np.asarray(got["stats"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy(dtype=np.float64))


def quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, with_text: bool = True) -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 if score >= 0.5).

    All columns of ``docs`` are kept (the text unless ``with_text`` is false; columns of the three names are replaced).
    A null text is an empty one and is scored as such. Labels that repeat a doc_id count by their mean; without usable
    labels of both classes every score is the prior. A null doc_id is scored, but not learnt from. A very long text costs
    time and memory in proportion, in one task. An empty table gives an empty result.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "score", "predicted") and (with_text or c != "text")]
    rows = docs.select(F.struct(*keep).alias("_row"), F.col("text").cast("string").alias("_text"))
    model = fit_quality(docs, labels, max_train)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], names=["_row", "score"])
        give_back()

    scored = rows.mapInArrow(run, T.StructType([T.StructField("_row", rows.schema["_row"].dataType), T.StructField("score", T.DoubleType())]))
    out = scored.select("_row.*", "score")
    return out.select("*", held_out("doc_id").alias("held_out"), (F.col("score") >= 0.5).cast("int").alias("predicted"))
