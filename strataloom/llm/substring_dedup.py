"""Substring deduplication over prefix-partitioned suffix trees.

Every word position starts a suffix of its document, which is looked at down to the depth of one window (20 words).
Suffixes are partitioned by prefixes of variable length: five words, or, where more than HOT suffixes share those, all
20. The five words need not be the first: they are the least 5-word sequence (by hash) that starts within the first 16
words, so neighbouring suffixes mostly have the same one and travel together, as one stretch of words. Suffixes that agree
on a window always have the same prefix.

First the prefixes are counted over all documents. Those that occur once hold no repeat, and their suffixes go no further.
The others are sent to memory-sized groups. In a group the subtree is built by prefix doubling: suffixes are ranked by
their first word, then by 2, 4, 8, 16 and 20 words, from the ranks of their halves; the ranks order them as the leaves of
the tree are, and leaves with one rank are below one internal node as deep as a window. Words are compared by 64-bit hashes
of each, windows that share a prefix of full length by 128 bits of all of it. Each deep node keeps its first leaf (smallest
document, then start); the others are repeats, and neighbouring repeats of a document make up its maximal repeats.

Texts are shuffled once, into parts by a hash of id and text; in a part equal stretches are combined before they are
sent, so a passage that a third of all documents hold costs one row a part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import mix, sequence_hashes, word_hashes

WINDOW = 20
PREFIX = 5
HOT = 20_000  # suffix stretches of one prefix in a group
PART_CHARS = 3_000_000  # of text in a part
GROUP_WORDS = 2_000_000  # in a group
NO_ID = -(2**63)
_U = np.uint64
_COUNT_SCHEMA = "bucket int, part long, prefixes binary, counts binary"
_KNOWN_SCHEMA = "part long, cold binary, hot binary"
_SENT_SCHEMA = "bucket int, kind int, doc_id long, text_hash long, blob binary"
_REPEAT_SCHEMA = "doc_id long, text_hash long, starts binary"
_RUN = np.dtype([("doc", "<u4"), ("start", "<u4"), ("count", "<u2")])
_NAMED = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<u4"), ("start", "<u4")])
_STRETCH, _WHOLE, _REPEAT = range(3)


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class Suffixes:
    """All suffixes of at least a window in some documents, in stretches that share a prefix (and its place)."""

    def __init__(self, texts: list[str | None]):
        self.words, lens = word_hashes(texts)
        ends = np.concatenate([[0], np.cumsum(lens)])
        usable = np.maximum(lens - WINDOW + 1, 0)
        self.begin = ends[:-1]
        doc = np.repeat(np.arange(len(texts)), usable)
        at = np.arange(usable.sum()) - np.repeat(np.cumsum(usable) - usable, usable) + self.begin[doc]
        if not len(at):
            self.first = self.count = self.doc = np.zeros(0, dtype=np.int64)
            self.prefix = np.zeros(0, dtype=np.uint64)
            return
        grams = sequence_hashes(self.words, PREFIX)
        least, place, step = grams, np.arange(len(grams)), 1
        while step < WINDOW - PREFIX + 1:  # the least of 2, 4, 8 and 16, the first of equals
            right = least[step:] < least[:-step]
            place = np.where(right, place[step:], place[:-step])
            least = np.where(right, least[step:], least[:-step])
            step *= 2
        del least
        anchor = place[at]
        del place
        cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        self.first = at[cut]  # position of the first suffix of each stretch
        self.count = np.diff(np.append(cut, len(at)))
        self.doc = doc[cut]
        self.prefix = grams[anchor[cut]]


def _bucket_edges(where: np.ndarray):
    """Order by bucket, and (bucket, from, to) of each."""
    order = np.argsort(where, kind="stable")
    w = where[order]
    edge = [0, *(np.flatnonzero(np.diff(w)) + 1).tolist(), len(w)] if len(w) else [0]
    return order, [(int(w[a]), a, b) for a, b in zip(edge, edge[1:])]


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], kinds[t]) for i, (n, t) in enumerate(fields)})


def _count_prefixes(buckets: int):
    """Different prefixes of a part, each with its number of stretches, by bucket."""

    def run(key, table):
        s = Suffixes(table.column("text").to_pylist())
        prefix, n = np.unique(s.prefix, return_counts=True)
        order, edges = _bucket_edges(((prefix >> _U(17)) % _U(buckets)).astype(np.int64))
        prefix, n = prefix[order], np.minimum(n[order], 65_535).astype("<u2")
        return _table(_COUNT_SCHEMA, [(b, key[0].as_py(), prefix[x:y].tobytes(), n[x:y].tobytes()) for b, x, y in edges])

    return run


def _stream(batches, key: list[str]):
    """Rows of each key; rows come sorted by it."""
    at, rows = None, []
    for batch in batches:
        names = batch.schema.names
        for row in zip(*(batch.column(i).to_pylist() for i in range(len(names)))):
            k = tuple(row[names.index(c)] for c in key)
            if k != at:
                if rows:
                    yield at, rows
                at, rows = k, []
            rows.append(row)
    if rows:
        yield at, rows


def _known(batches):
    """Of each part the prefixes that occur more than once over all: those whose group fits, and those that are too many."""
    for _, rows in _stream(batches, ["bucket"]):
        prefix = np.concatenate([np.frombuffer(r[2], "<u8") for r in rows])
        n = np.concatenate([np.frombuffer(r[3], "<u2") for r in rows]).astype(np.int64)
        _, at = np.unique(prefix, return_inverse=True)
        total = np.bincount(at, weights=n)[at]
        out, x = [], 0
        for r in rows:
            y = x + len(r[3]) // 2
            cold, hot = (total[x:y] > 1) & (total[x:y] <= HOT), total[x:y] > HOT
            if cold.any() or hot.any():
                out.append((r[1], prefix[x:y][cold].tobytes(), prefix[x:y][hot].tobytes()))
            x = y
        if out:
            yield from _table(_KNOWN_SCHEMA, out).to_batches()


def _in(values: np.ndarray, blobs: list[bytes]) -> np.ndarray:
    known = np.sort(np.frombuffer(b"".join(blobs), "<u8"))
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _by_doc(doc: np.ndarray, start: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> list[tuple]:
    """(doc_id, text_hash, starts) of each document."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order].astype("<u4")
    edge = [0, *(np.flatnonzero(np.diff(doc)) + 1).tolist(), len(doc)] if len(doc) else [0]
    return [(int(ids[doc[x]]), int(hashes[doc[x]]), start[x:y].tobytes()) for x, y in zip(edge, edge[1:])]


def _send(buckets: int):
    """Stretches of a part with their words, by prefix; suffixes of prefixes that too many share one by one, by their window; equal ones once."""

    def run(key, texts, known):
        if not known.num_rows or not texts.num_rows:
            return _table(_SENT_SCHEMA, [])
        ids, hashes, text = (texts.column(c).to_pylist() for c in ("_id", "_hash", "text"))
        one = {(i, h): t for i, h, t in zip(ids, hashes, text)}  # repeated rows are one document
        docs = sorted(one)
        ids, hashes = np.asarray([d[0] for d in docs], "<i8"), np.asarray([d[1] for d in docs], "<i8")
        s = Suffixes([one[d] for d in docs])
        out: list[tuple] = []
        doc, start = [], []  # of suffixes that repeat one of this part

        def head(used, *arrays):
            return b"".join([np.asarray([len(used), *map(len, arrays)], "<i8").tobytes(), ids[used].tobytes(), hashes[used].tobytes(), *(a.tobytes() for a in arrays)])

        cold = np.flatnonzero(_in(s.prefix, known.column("cold").to_pylist()))
        raw, seen, keep = s.words.tobytes(), set(), []
        for i, a, n in zip(cold.tolist(), s.first[cold].tolist(), s.count[cold].tolist()):
            words = raw[8 * a : 8 * (a + n + WINDOW - 1)]
            if words in seen:
                doc.append(np.full(n, s.doc[i]))
                start.append(np.arange(a, a + n) - s.begin[s.doc[i]])
            else:
                seen.add(words)
                keep.append(i)
        keep = np.asarray(keep, dtype=np.int64)
        order, edges = _bucket_edges(((s.prefix[keep] >> _U(17)) % _U(buckets)).astype(np.int64))
        keep = keep[order]
        for b, x, y in edges:
            some = keep[x:y]
            used, local = np.unique(s.doc[some], return_inverse=True)
            runs = np.zeros(len(some), dtype=_RUN)
            runs["doc"], runs["start"], runs["count"] = local, s.first[some] - s.begin[s.doc[some]], s.count[some]
            words = np.frombuffer(b"".join(raw[8 * a : 8 * (a + n + WINDOW - 1)] for a, n in zip(s.first[some].tolist(), s.count[some].tolist())), "<u8")
            out.append((b, _STRETCH, None, None, head(used, runs, words)))

        hot = np.flatnonzero(_in(s.prefix, known.column("hot").to_pylist()))
        if len(hot):
            n = s.count[hot]
            at = np.repeat(s.first[hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own = np.repeat(s.doc[hot], n)
            a, b = sequence_hashes(s.words, WINDOW)[at], sequence_hashes(mix(s.words + _U(0x2545F4914F6CDD1D)), WINDOW)[at]
            order = np.lexsort((at, b, a))  # positions are in the documents' order
            again = np.zeros(len(at), dtype=bool)
            again[order[1:]] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
            doc.append(own[again])
            start.append((at - s.begin[own])[again])
            rest = np.flatnonzero(~again)
            order, edges = _bucket_edges((a[rest] % _U(buckets)).astype(np.int64))
            rest = rest[order]
            for k, x, y in edges:
                some = rest[x:y]
                used, local = np.unique(own[some], return_inverse=True)
                names = np.zeros(len(some), dtype=_NAMED)
                names["a"], names["b"], names["doc"], names["start"] = a[some], b[some], local, (at - s.begin[own])[some]
                out.append((k, _WHOLE, None, None, head(used, names)))
        if doc:
            out += [(abs(h) % buckets, _REPEAT, i, h, x) for i, h, x in _by_doc(np.concatenate(doc), np.concatenate(start), ids, hashes)]
        return _table(_SENT_SCHEMA, out)

    return run


def _ranks(words: np.ndarray) -> np.ndarray:
    """Rank of every suffix by its first WINDOW words: equal for equal words, in one order (of word hashes) for all."""
    rank = {1: np.unique(words, return_inverse=True)[1].astype(np.uint64)}

    def join(a: int, b: int) -> np.ndarray:
        left, right = rank[a], rank[b][a:]
        left = left[: len(right)]
        return np.unique(left * (right.max(initial=_U(0)) + _U(1)) + right, return_inverse=True)[1].astype(np.uint64)

    for a, b in ((1, 1), (2, 2), (4, 4), (8, 8), (16, 4)):
        rank[a + b] = join(a, b)
    return rank[WINDOW]


def _open(rows: list[tuple], *kinds):
    """Document ids, text hashes and arrays of many blobs, with the arrays' own offsets of documents."""
    ids, hashes, arrays, base, docs = [], [], [[] for _ in kinds], [], 0
    for r in rows:
        sizes = np.frombuffer(r[4], "<i8", 1 + len(kinds))
        nd, at = int(sizes[0]), 8 * (1 + len(kinds))
        ids.append(np.frombuffer(r[4], "<i8", nd, at))
        hashes.append(np.frombuffer(r[4], "<i8", nd, at + 8 * nd))
        at += 16 * nd
        for out, kind, n in zip(arrays, kinds, sizes[1:].tolist()):
            out.append(np.frombuffer(r[4], kind, n, at))
            at += np.dtype(kind).itemsize * n
        base.append(np.full(int(sizes[1]), docs))
        docs += nd
    return np.concatenate(ids), np.concatenate(hashes), np.concatenate(base), [np.concatenate(a) for a in arrays]


def _deep_nodes(ids, hashes, doc, start, names: list[np.ndarray]) -> list[tuple]:
    """(doc_id, text_hash, starts) of all leaves but the first of each node."""
    pair = np.zeros(len(ids), dtype=[("id", "<i8"), ("hash", "<i8")])
    pair["id"], pair["hash"] = ids, hashes
    which, rank = np.unique(pair, return_inverse=True)
    own = rank[doc]
    leaf = np.lexsort((start, own, *names))
    same = np.ones(len(leaf) - 1, dtype=bool)
    for n in names:
        same &= n[leaf[1:]] == n[leaf[:-1]]
    hit = leaf[1:][same]
    return _by_doc(own[hit], start[hit], which["id"], which["hash"])


def _subtrees(batches):
    """The repeats of each group."""
    for (_, kind), rows in _stream(batches, ["bucket", "kind"]):
        if kind == _REPEAT:
            out = [(r[2], r[3], r[4]) for r in rows]
        elif kind == _WHOLE:
            ids, hashes, base, (names,) = _open(rows, _NAMED)
            out = _deep_nodes(ids, hashes, base + names["doc"], names["start"].astype(np.int64), [names["b"], names["a"]])
        else:
            ids, hashes, base, (runs, words) = _open(rows, _RUN, "<u8")
            n = runs["count"].astype(np.int64)
            at = np.cumsum(n + WINDOW - 1) - (n + WINDOW - 1)  # where the words of each stretch begin
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc, start = np.repeat(base + runs["doc"], n), np.repeat(runs["start"].astype(np.int64), n) + step
            out = _deep_nodes(ids, hashes, doc, start, [_ranks(words)[np.repeat(at, n) + step]])
        if out:
            yield from _table(_REPEAT_SCHEMA, out).to_batches()


def _cut_out(with_text: bool):
    def run(key, texts, repeats):
        starts: dict[tuple, list[bytes]] = {}
        for i, h, x in zip(*(repeats.column(c).to_pylist() for c in ("_id", "_hash", "starts"))):
            starts.setdefault((i, h), []).append(x)
        cols = [[], [], []]
        for i, h, text in zip(*(texts.column(c).to_pylist() for c in ("_id", "_hash", "text"))):
            words = split_words(text)
            n = len(words)
            if (i, h) in starts:
                edge = np.zeros(n + 1, dtype=np.int64)
                edge[np.concatenate([np.frombuffer(x, "<u4") for x in starts[i, h]])] = 1
                seen = np.cumsum(edge)
                seen[WINDOW:] -= seen[:-WINDOW].copy()
                words = [w for w, o in zip(words, seen.tolist()) if not o]
            for c, v in zip(cols, (n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass"))):
                c.append(v)
        out = {"_row": texts.column("_row"), "n_words": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()), "kept_text": pa.array(cols[2], pa.string())}
        return pa.table(out | ({"text": texts.column("text")} if with_text else {}))

    return run


def substring_dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text: words covered by a window that also starts earlier are gone.

    The other columns of ``docs`` are kept (the text itself unless ``with_text`` is false), but for those three names.
    A null text has no words. A null doc_id counts as the smallest. Rows that repeat doc_id and text are one document
    (each row gets its result); rows that repeat a doc_id with another text are different documents, ordered by a hash
    of the text. A very long text is in one task's memory, about 60 bytes a word. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_words", "n_removed", "kept_text")]
    rows = docs.select(F.struct(*keep).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_hash"), F.col("text").cast("string").alias("text"))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // (4 * PART_CHARS)), 1)
    buckets = max(n, -(-chars // (4 * GROUP_WORDS)))
    part = F.pmod(F.xxhash64("_id", "_hash"), F.lit(max(4 * n, -(-chars // PART_CHARS)))).alias("part")
    parts = rows.select("*", part).repartition(n, "part")  # the one shuffle of the texts: three steps read it
    by_part = parts.groupBy("part")

    counted = by_part.applyInArrow(_count_prefixes(buckets), _COUNT_SCHEMA)
    known = counted.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_known, _KNOWN_SCHEMA)
    sent = by_part.cogroup(known.groupBy("part")).applyInArrow(_send(buckets), _SENT_SCHEMA)
    found = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_subtrees, _REPEAT_SCHEMA)
    repeats = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "starts").select("*", part)
    fields = [T.StructField("_row", rows.schema["_row"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("text", T.StringType())]
    out = by_part.cogroup(repeats.groupBy("part")).applyInArrow(_cut_out(with_text), T.StructType(fields[: 4 + with_text]))
    return out.select("_row.*", *["text"] * with_text, "n_words", "n_removed", "kept_text")
