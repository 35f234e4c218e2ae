"""N-gram Jaccard join by PartEnum signatures.

Two sets of sizes s and t with a Jaccard similarity of at least 3/4 differ in at most (s + t) / 7 features. Sets are
joined by size band, that of the smaller one; a set near the lower end of its band also takes part in the band below. In a
band the feature domain is partitioned by hash, first into partitions, then each of these into three parts. If two sets
differ in a partition in one part at most, two of its parts agree: every subset of two parts is enumerated, and the
features in it, with band, partition and subset, are a signature.

A set takes partitions in their order until it is certain to share a signature with every set that it may link with: a
partition in which c of its parts hold a feature that counts stands for min(2, c) differences, so partitions that stand
for more differences than the set may have are enough. (Of two sets, the one that takes fewer has that certainty within
partitions that the other takes too.) Features that are in many documents do not count on the first levels, which keeps
boilerplate out of the signatures; a set that has too few others takes the next level too, on which more count. On the last
level every feature is a partition of its own, which is always enough. How many documents hold a feature is counted over all
documents in a table of fixed size, by hash.

Sets that share a signature are compared exactly on their words. Lists of such sets are never expanded into all pairs:
every member is first compared with the smallest one of its list, then, after components are known, members of different
components are; of all these pairs only those are verified that a lower bound on their difference leaves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cuts, components, written
from .words import chunks, mix, sequence_hashes, word_hashes

SHINGLE = 5
CHUNK_CHARS = 2_000_000
FEATURES = 50_000  # of sets that are worked on together
LIST_ROWS = 20_000  # members of a list in one row
BLOCK = 2_048  # members of a list that are compared in one task
ENTRIES = 4_000_000  # signatures in a bucket
BINS = 1024  # of a sketch
LARGE = 512  # features above which a sketch holds counts, not only their parities
COARSE = 256  # bins of the counts by which members of a list are compared
FEW_IDS = 2_000_000  # document ids that are broadcast (16 bytes each); more are joined by a shuffle of the texts
COUNTERS = 2**21  # size of the table of feature counts, whatever the input
SLICE = 2**16
PARTS = 3
SUBSETS = ((0, 1), (0, 2), (1, 2))  # of PARTS parts, all but one
#: Levels: a feature counts if it is in at most (this many times the mean of a counter, and twice that); partitions, in times those of the first.
LEVELS = ((4, 1), (4, 2), (256, 1), (None, 1), (None, 4), (None, None))
SALTED = 3  # first level on which signatures may be in any share of the documents
SALTS = 64
_U = np.uint64
_TAG = np.dtype([("id", "<i8"), ("tag", "<u4")])
_SIG = np.dtype([("low", "<u4"), ("high", "u1"), ("doc", "<u2")])

_SET_SCHEMA = "doc_id long, n_shingles long, digest binary, sketch binary, coarse binary, slice int, counts binary"
_SIG_SCHEMA = "bucket long, docs binary, sigs binary"
_LIST_SCHEMA = "list_id long, members array<long>"


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted different hashes of each text's shingles: ASCII lower case, words between ASCII white space."""
    h, counts = word_hashes(texts, lower=True)
    runs, out, at = sequence_hashes(h, SHINGLE), [], 0
    for n in counts.tolist():
        f = np.sort(runs[at : at + n - SHINGLE + 1]) if n >= SHINGLE else sequence_hashes(h[at : at + n], n) if n else h[:0]
        out.append(f[np.concatenate([[True], f[1:] != f[:-1]])] if len(f) > 1 else f)
        at += n
    return out


def exact_shingles(text: str) -> set:
    """The shingles themselves, for exact verification."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    return {tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)} if len(w) >= SHINGLE else ({tuple(w)} if w else set())


def digest(features: np.ndarray) -> bytes:
    return hashlib.blake2b(features.tobytes(), digest_size=16).digest()


def instances(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, band, most differences) of every join that a set takes part in: its own band's, and the one below's if a smaller partner may be there."""
    own = np.frexp(sizes.astype(np.float64))[1] - 1
    low = np.frexp(np.ceil(0.75 * sizes))[1] - 1
    two = np.flatnonzero(low < own)
    most = (sizes + 4 * sizes // 3) // 7
    below = (sizes[two] + np.minimum(sizes[two], 2 ** (low[two] + 1) - 1)) // 7
    return np.concatenate([np.arange(len(sizes)), two]), np.concatenate([own, low[two]]), np.concatenate([most, below])


def level_signatures(level: int, features: np.ndarray, rare: np.ndarray, owner: np.ndarray, bands: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of one level: (signature, instance) pairs, and whether each instance has enough.

    ``features`` with ``rare`` (counts on this level) and ``owner`` (instance), grouped by owner; bands and most by instance.
    """
    n = len(bands)
    salt = _U(level * 1_000_003 + 17)
    times = LEVELS[level][1]
    if times is None:  # every feature is a partition: the first ones by hash that outnumber the differences
        h = mix(features + salt)
        order = np.lexsort((h, owner))
        at = owner[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = order[place <= most[at]]
        return mix(h[keep] + bands[owner[keep]].astype(np.uint64) * _U(65_537)), owner[keep], np.ones(n, dtype=bool)
    count = np.maximum(1, (2 ** (bands + 1) * times) // 4)
    first = np.concatenate([[0], np.cumsum(count)])
    h = mix(features + salt)
    slot = (first[owner] * PARTS + (h % (count[owner] * PARTS).astype(np.uint64)).astype(np.int64)).astype(np.int64)
    size = int(first[-1]) * PARTS
    h = mix(h)
    low = np.bincount(slot, weights=(h & _U(0xFFFFFFFF)).astype(np.float64), minlength=size)
    high = np.bincount(slot, weights=(h >> _U(32)).astype(np.float64), minlength=size)
    content = mix(low.astype(np.uint64) + (high.astype(np.uint64) << _U(32))).reshape(-1, PARTS)
    counts = (np.bincount(slot[rare], minlength=size) > 0).reshape(-1, PARTS)
    instance = np.repeat(np.arange(n), count)
    stands = np.minimum(counts.sum(axis=1), 2)
    total = np.cumsum(stands)
    before = np.concatenate([[0], total])[first[:-1]]  # of the instances before
    taken = total - stands - before[instance] <= most[instance]  # partitions up to the one with which it is enough
    enough = np.add.reduceat(stands, first[:-1]) > most if n else np.zeros(0, dtype=bool)
    number = np.arange(len(instance)) - first[:-1][instance]
    name = bands[instance].astype(np.uint64) * _U(0x9E3779B97F4A7C15) + number.astype(np.uint64) * _U(31) + salt
    sigs, owners = [], []
    for k, (a, b) in enumerate(SUBSETS):
        pick = np.flatnonzero(taken & (counts[:, a] | counts[:, b]))
        sigs.append(mix(content[pick, a] * _U(3) + content[pick, b] * _U(5) + mix(name[pick] + _U(k) * _U(0x51ED2701))))
        owners.append(instance[pick])
    return np.concatenate(sigs), np.concatenate(owners), enough


def signatures(sets: list[np.ndarray], commonness: np.ndarray, limits: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set, level) of all ``sets`` (none empty), worked out for about FEATURES of their features at a time."""
    sizes = np.asarray([len(s) for s in sets], dtype=np.int64)
    turn = np.cumsum(sizes) // FEATURES
    cut = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(sets)]
    out = [[np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int8)]]
    for a, b in zip(cut, cut[1:]):
        for sig, own, level in _levels(sets[a:b], sizes[a:b], commonness, limits):
            for c, v in zip(out, (sig, own + a, np.full(len(sig), level, dtype=np.int8))):
                c.append(v)
    return tuple(np.concatenate(c) for c in out)


def _levels(sets: list[np.ndarray], sizes: np.ndarray, commonness: np.ndarray, limits: list[int]):
    """(signatures, their sets, level) level by level, until every set has enough."""
    flat, start = np.concatenate(sets), np.cumsum(sizes) - sizes
    common = commonness[(flat >> _U(40)) & _U(COUNTERS - 1)].astype(np.int16)
    which, bands, most = instances(sizes)
    for level in range(len(LEVELS)):
        if not len(which):
            return
        lens = sizes[which]
        at = np.repeat(start[which] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        sig, own, enough = level_signatures(level, flat[at], common[at] <= limits[level], np.repeat(np.arange(len(which)), lens), bands, most)
        yield sig, which[own], level
        which, bands, most = which[~enough], bands[~enough], most[~enough]


def sketch(features: np.ndarray) -> bytes:
    """Parities of the feature counts in BINS bins; for large sets, of which these say nothing, also the counts (up to 255).

    Two sets differ in at least as many features as their parities do in bits, and as their counts do in sum.
    """
    counts = np.bincount((features >> _U(7)).astype(np.int64) & (BINS - 1), minlength=BINS)
    bits = np.packbits((counts & 1).astype(np.uint8)).tobytes()
    return bits + np.minimum(counts, 255).astype(np.uint8).tobytes() if len(features) > LARGE else bits


def coarse(features: np.ndarray) -> bytes:
    """Of large sets the counts in fewer bins (up to 255), which differ by no more; of others nothing."""
    if len(features) <= LARGE:
        return b""
    return np.minimum(np.bincount((features >> _U(7)).astype(np.int64) & (COARSE - 1), minlength=COARSE), 255).astype(np.uint8).tobytes()


def may_link(n: np.ndarray, sketches: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) of sets may link: sizes within 4/3, and no more than a 7th of the features certain to differ."""
    ok = np.flatnonzero((4 * n[i] >= 3 * n[j]) & (4 * n[j] >= 3 * n[i]))
    bits = np.frombuffer(b"".join(x[: BINS // 8] for x in sketches), np.uint64).reshape(len(sketches), -1)
    ok = np.concatenate([k[7 * np.bitwise_count(bits[i[k]] ^ bits[j[k]]).sum(axis=1, dtype=np.int64) <= n[i[k]] + n[j[k]]] for k in _slices(ok)])
    large = [x for x in range(len(sketches)) if len(sketches[x]) > BINS // 8]
    place = np.full(len(sketches), -1)
    place[large] = np.arange(len(large))
    counts = np.frombuffer(b"".join(sketches[x][BINS // 8 :] for x in large), np.uint8).reshape(-1, BINS)
    both = (place[i[ok]] >= 0) & (place[j[ok]] >= 0)
    near = [k[7 * np.abs(counts[place[i[k]]].astype(np.int16) - counts[place[j[k]]]).sum(axis=1, dtype=np.int64) <= n[i[k]] + n[j[k]]] for k in _slices(ok[both])]
    return np.sort(np.concatenate([ok[~both], *near]))


def _slices(x: np.ndarray, size: int = 2048):
    return [x[k : k + size] for k in range(0, max(len(x), 1), size)]


def _measure(batches):
    """Size, digest and sketch of every document's set, and at the end how many documents of the partition hold a feature of each counter, in slices."""
    names = ["doc_id", "n_shingles", "digest", "sketch", "coarse", "slice", "counts"]
    total = np.zeros(COUNTERS, dtype=np.uint32)
    for ids, texts in chunks(batches, 2, CHUNK_CHARS):
        sets = shingle_sets(texts)
        np.add.at(total, ((np.concatenate(sets) >> _U(40)) & _U(COUNTERS - 1)).astype(np.int32), np.uint32(1))
        n = len(ids)
        own = [[make(s) if len(s) else None for s in sets] for make in (digest, sketch, coarse)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(c, pa.binary()) for c in own), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
    if total.any():
        n = COUNTERS // SLICE
        rows = [np.minimum(total[i : i + SLICE], 65535).astype("<u2").tobytes() for i in range(0, COUNTERS, SLICE)]
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *(pa.nulls(n, pa.binary()) for _ in range(3)), pa.array(range(n), pa.int32()), pa.array(rows, pa.binary())], names=names)


def _sum_counts(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[i] = total.get(i, 0) + np.frombuffer(c, "<u2").astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([int(t.sum()) for t in total.values()], pa.int64()), pa.array([_log(t).astype(np.uint8).tobytes() for t in total.values()], pa.binary())], names=["slice", "features", "counts"])


def _log(count):
    return np.minimum(8 * np.log2(1 + count), 255)


def commonness(measured: DataFrame) -> tuple[np.ndarray, int]:
    """For each counter, a logarithm of how many documents hold its features (COUNTERS bytes); and the number of features of all documents."""
    counts = measured.where("slice is not null").select("slice", "counts").repartition(COUNTERS // SLICE, "slice").mapInArrow(_sum_counts, "slice int, features long, counts binary")
    out, features = np.zeros(COUNTERS, dtype=np.uint8), 0
    for r in counts.collect():  # COUNTERS bytes in all
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.uint8)
        features += r["features"]
    return out, features


def limits_of(features: int) -> list[int]:
    """Of each level, the largest logarithm of a feature that counts."""
    mean = features / COUNTERS
    return [256 if times is None else int(_log(times * (mean + 2))) for times, _ in LEVELS]


def _deal(buckets: int, common, limits: list[int]):
    """Signatures of every chunk of documents by bucket; equal sets of a chunk give theirs once, for the smallest document."""
    names = ["bucket", "docs", "sigs"]

    def rows(ids, tags, sets, salt):
        sig, own, level = signatures(sets, common.value, limits)
        hot = level >= SALTED  # such a signature goes to a bucket of its own in each of SALTS shares of the chunks
        where = (mix(sig + np.where(hot, salt, 0).astype(np.uint64)) % _U(buckets)).astype(np.int64) * 2 + hot
        order = np.argsort(where, kind="stable")
        sig, own, where = sig[order], own[order], where[order]
        edge = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(where)]
        for a, b in zip(edge, edge[1:]):
            used, local = np.unique(own[a:b], return_inverse=True)
            docs, s = np.zeros(len(used), dtype=_TAG), np.zeros(b - a, dtype=_SIG)
            docs["id"], docs["tag"] = ids[used], tags[used]
            s["low"], s["high"], s["doc"] = sig[a:b] & _U(0xFFFFFFFF), (sig[a:b] >> _U(32)) & _U(0xFF), local
            yield int(where[a]), docs.tobytes(), s.tobytes()

    def run(batches):
        for ids, texts in chunks(batches, 2, CHUNK_CHARS):
            own: dict[bytes, tuple[int, np.ndarray]] = {}
            for i, f in zip(ids, shingle_sets(texts)):
                if i is None or not len(f):
                    continue
                d = digest(f)
                if d not in own or i < own[d][0]:
                    own[d] = i, f
            one = list(own.items())
            for at in range(0, len(one), 60_000):
                some = one[at : at + 60_000]
                doc = np.asarray([v[0] for _, v in some], dtype=np.int64)
                tag = np.asarray([int.from_bytes(d[:4], "little") for d, _ in some], dtype=np.uint32)
                out = list(rows(doc, tag, [v[1] for _, v in some], 1 + int(doc.min()) % SALTS))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary())], names=names)

    return run


def _bucket_lists(bucket: int, parts: list[tuple[bytes, bytes]]):
    """Lists of at least two documents that share a signature of this bucket, each list once; salted ones are all kept, they are parts of one."""
    docs = [np.frombuffer(d, _TAG) for d, _ in parts]
    sigs = [np.frombuffer(s, _SIG) for _, s in parts]
    base = np.repeat(np.concatenate([[0], np.cumsum([len(d) for d in docs])[:-1]]), [len(s) for s in sigs])
    docs, sigs = np.concatenate(docs), np.concatenate(sigs)
    who = base + sigs["doc"]
    sig = sigs["low"].astype(np.uint64) | (sigs["high"].astype(np.uint64) << _U(32))
    order = np.argsort(sig, kind="stable")
    twice = sig[order][1:] == sig[order][:-1]
    keep = np.zeros(len(order), dtype=bool)
    keep[1:] |= twice
    keep[:-1] |= twice
    salted = bool(bucket & 1)
    order = order if salted else order[keep]
    sig, who = sig[order], who[order]
    order = np.lexsort((docs["id"][who], docs["tag"][who], sig))
    sig, doc, tag = sig[order], docs["id"][who[order]], docs["tag"][who[order]]
    first = np.ones(len(sig), dtype=bool)
    first[1:] = (sig[1:] != sig[:-1]) | (tag[1:] != tag[:-1])  # equal sets: the smallest document
    sig, doc = sig[first], doc[first]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(start, len(sig)))
    some = np.flatnonzero(size > (0 if salted else 1))
    seen = set()
    for a, n in zip(start[some].tolist(), size[some].tolist()):
        members = np.sort(doc[a : a + n])
        if salted:
            list_id = int(sig[a] << _U(8) | _U(7)) - 2**62
        else:
            list_id = int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)
            if list_id in seen:
                continue
            seen.add(list_id)
        for k in range(0, n, LIST_ROWS):
            yield list_id, members[k : k + LIST_ROWS]


def _lists(batches):
    names = ["list_id", "members"]

    def flush(bucket, parts):
        rows = list(_bucket_lists(bucket, parts))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=names)

    bucket, parts = None, []
    for batch in batches:
        for b, d, s in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if b != bucket:
                if parts:
                    yield from flush(bucket, parts)
                bucket, parts = b, []
            parts.append((d, s))
    if parts:
        yield from flush(bucket, parts)


def _verify(batches):
    for batch in batches:
        keep_a, keep_b, last, sa = [], [], None, None
        ids = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())
        for (x, y), tx, ty in zip(ids, batch.column("ta"), batch.column("tb")):
            tx = tx.as_py()  # one pair of texts at a time
            if (x, tx) != last:
                last, sa = (x, tx), exact_shingles(tx)
            sb = exact_shingles(ty.as_py())
            both = len(sa & sb)
            if 100 * both >= 75 * (len(sa) + len(sb) - both):
                keep_a.append(x)
                keep_b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], names=["a", "b"])


def _closer(batches):
    """Pairs (a, na, sa, b, nb, sb) that may link."""
    for batch in batches:
        n = batch.num_rows
        sizes = np.concatenate([batch.column(c).to_numpy() for c in ("na", "nb")])
        keep = pa.array(may_link(sizes, batch.column("sa").to_pylist() + batch.column("sb").to_pylist(), np.arange(n), np.arange(n, 2 * n)))
        yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("a", "b")], names=["a", "b"])


def _apart(closest: bool):
    """Pairs of different components, in one pair of blocks of a list, that may link; of each two components all, or the ``closest`` one that is met.

    Rows come sorted by list, pair of blocks and side.
    """

    def compare(rows: pa.Table):
        group = np.cumsum(np.concatenate([[0], np.any([np.diff(rows.column(c).to_numpy()) != 0 for c in ("list_id", "bi", "bj")], axis=0)]))
        side, doc, comp, n, bi, bj = (rows.column(c).to_numpy() for c in ("side", "doc_id", "component", "n", "bi", "bj"))
        sketches = rows.column("sketch").to_pylist()
        bits = np.frombuffer(b"".join(x[: BINS // 8] for x in sketches), np.uint64).reshape(len(group), -1)
        large = np.asarray([len(x) > BINS // 8 for x in sketches])
        place = np.cumsum(large) - 1
        counts = np.frombuffer(b"".join(x[BINS // 8 :] for x in sketches), np.uint8).reshape(-1, COARSE)
        pairs, left, step = [np.zeros((0, 3), dtype=np.int64)], np.arange(len(group)), 1
        while len(left := left[left + step < len(group)]) and len(left := left[group[left] == group[left + step]]):
            right = left + step
            ok = (comp[left] != comp[right]) & ((bi[left] == bj[left]) | (side[left] != side[right])) & (4 * n[left] >= 3 * n[right]) & (4 * n[right] >= 3 * n[left])
            a, b = left[ok], right[ok]
            far = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
            near = 7 * far <= n[a] + n[b]
            both = np.flatnonzero(near & large[a] & large[b])  # parities say nothing of them
            for k in _slices(both):
                apart = np.abs(counts[place[a[k]]].astype(np.int16) - counts[place[b[k]]]).sum(axis=1, dtype=np.int64)
                far[k], near[k] = np.maximum(far[k], apart), 7 * apart <= n[a[k]] + n[b[k]]
            pairs.append(np.stack([a[near], b[near], far[near]], axis=1))
            step += 1
        pairs = np.concatenate(pairs)
        if closest and len(pairs):
            _, at = np.unique(comp, return_inverse=True)
            two = np.sort(at[pairs[:, :2]], axis=1)
            order = np.lexsort((pairs[:, 2], two[:, 1], two[:, 0]))
            pairs = pairs[order[np.flatnonzero(np.concatenate([[True], np.any(np.diff(two[order], axis=0) != 0, axis=1)]))]]
        ids, at = np.unique(doc, return_inverse=True)
        both = np.sort(at[pairs[:, :2]], axis=1)
        both = np.unique(both[:, 0] * len(ids) + both[:, 1])  # each pair of documents once, whatever the number of their lists
        return pa.RecordBatch.from_arrays([pa.array(ids[both // max(len(ids), 1)]), pa.array(ids[both % max(len(ids), 1)])], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 8 * BLOCK:
                continue
            rows = pa.Table.from_batches(held)
            keys = [rows.column(c).to_numpy() for c in ("list_id", "bi", "bj")]
            cut = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))  # the last group may go on
            end = int(cut[-1]) + 1 if len(cut) else 0
            if end:
                yield compare(rows.slice(0, end))
            held = rows.slice(end).to_batches()
        if held:
            yield compare(pa.Table.from_batches(held))

    return run


def _alike_lists(rows: DataFrame) -> DataFrame:
    """Members of lists (list_id, m, pivot, doc_id, component), lists of one smallest member as one if they hold much the same members.

    A group of copies gives many such lists; together they have at most twice the members of the largest, so as one they are
    fewer pairs, and each pair is met once.
    """
    of = rows.groupBy("pivot").agg(F.countDistinct("doc_id").alias("all"), F.max("m").alias("most"), F.countDistinct("list_id").alias("lists")).where("lists > 1 and all <= 2 * most")
    both = rows.join(of.select("pivot", "all"), "pivot", "left")
    return both.select(F.when(F.col("all").isNotNull(), F.xxhash64("pivot")).otherwise(F.col("list_id")).alias("list_id"), F.coalesce("all", "m").alias("m"), "doc_id", "component")


def _joined(comp: DataFrame, more: DataFrame) -> DataFrame:
    """Components (id, component) with further links (a, b): those of the components that the links join, put in their place."""
    of = lambda end: comp.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    up = components(between)
    moved = comp.join(up.select(F.col("id").alias("component"), F.col("component").alias("up")), "component", "left").select("id", F.coalesce("up", "component").alias("component"))
    return moved.unionByName(up.join(comp.select("id"), "id", "left_anti"))


def ngram_join(docs: DataFrame) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of at least 0.75 on 5-word shingles.

    Returns (doc_id, n_shingles, component_id) per row of ``docs``; other columns are not looked at. A null or blank
    text has an empty set, no links, and is its own component. A null doc_id links with nothing and has a null
    component. Rows that repeat a doc_id with different texts are one document whose links are those of any of its
    texts. A very long text is one set in one task's memory, about 8 bytes a word. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    cuts = Cuts(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = cuts.written(base.mapInArrow(_measure, _SET_SCHEMA), "ngram-sets")
    info = measured.where("slice is null").select("doc_id", "n_shingles", "digest")
    sketches = measured.where("digest is not null and doc_id is not null").select("doc_id", F.col("n_shingles").alias("n"), "sketch", "coarse")
    counted, features = commonness(measured)
    common = spark.sparkContext.broadcast(counted)  # of fixed size
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-features // ENTRIES), 1)
    dealt = base.mapInArrow(_deal(buckets, common, limits_of(features)), _SIG_SCHEMA).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    lists = cuts.written(dealt.mapInArrow(_lists, _LIST_SCHEMA), "ngram-lists")

    # Equal sets: each document with the smallest one.
    rep = info.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("b"), F.count("*").alias("copies")).where("copies > 1")
    copies = info.where("doc_id is not null").join(rep, "digest").where("doc_id != b").select(F.col("doc_id").alias("a"), "b")

    # Each member against its list's pivot, the smallest one.
    pivots = lists.groupBy("list_id").agg(F.min(F.col("members")[0]).alias("a"), F.sum(F.size("members")).alias("m"))
    member = lists.select("list_id", F.explode("members").alias("doc_id"))
    star = member.join(pivots.where("m > 1"), "list_id").where("a != doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    x = sketches.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    y = sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def closer(pairs: DataFrame, tag: str) -> DataFrame:
        both = pairs.join(y, "b").join(x, "a").select("a", "na", "sa", "b", "nb", "sb")
        return cuts.written(both.mapInArrow(_closer, "a long, b long").distinct(), tag)

    def verified(pairs: DataFrame) -> DataFrame:
        met = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        met = F.broadcast(met) if met.count() <= FEW_IDS else met
        texts = base.join(met, "doc_id", "left_semi").where("text is not null").dropDuplicates(["doc_id", "text"])
        texts = cuts.written(texts, "ngram-texts")
        ta, tb = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"t{k}")) for k in ("a", "b"))
        return pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long").distinct()

    links = cuts.written(verified(closer(star, "ngram-near")).unionByName(copies), "ngram-links")
    comp = components(links)

    # Then members of one list in different components, in pairs of blocks where the list is long: first the closest pair of each
    # two components, which joins most of what belongs together, then all pairs of what is still apart.
    bits = sketches.select("doc_id", "n", F.concat(F.substring("sketch", 1, BINS // 8), "coarse").alias("sketch"))
    for closest in (True, False):
        labelled = member.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        open_ = labelled.groupBy("list_id").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("m"), F.min("doc_id").alias("pivot")).where("c0 != c1 and m > 2")
        rows = cuts.written(labelled.join(open_.select("list_id", "m", "pivot"), "list_id").select("list_id", "m", "pivot", "doc_id", "component").distinct(), "ngram-open")
        left = _alike_lists(rows).select("list_id", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb"), "doc_id", "component").distinct()
        left = left.join(bits, "doc_id").withColumn("x", F.pmod(F.xxhash64("doc_id"), "nb").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        left = left.select("list_id", F.least("x", "o").alias("bi"), F.greatest("x", "o").alias("bj"), (F.col("x") > F.col("o")).cast("int").alias("side"), "doc_id", "component", "n", "sketch")
        left = left.repartition(buckets, "list_id", "bi", "bj").sortWithinPartitions("list_id", "bi", "bj", "side")
        cross = left.mapInArrow(_apart(closest), "a long, b long").distinct()
        more = cuts.written(verified(closer(cross, "ngram-apart")), "ngram-more")
        if not more.isEmpty():
            comp = cuts.written(_joined(comp, more), "ngram-components")
    got = info.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    got = written(got.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")), "ngram-out")
    common.destroy()
    cuts.clear()  # lists, texts and pairs are of the size of the input; only the result stays
    return got

