"""Byte-level BPE encoding and decoding with a minimal acyclic automaton as the lexicon of frequent words.

The lexicon holds words with known ids. It is a minimal deterministic acyclic automaton: equal suffixes share their
states, and each edge carries the number of words that sort before it, so walking a word also gives its number, under
which an offset table finds its ids. The flat arrays are one file, shipped by Spark to every executor and memory-mapped
there. Words outside it are merged exactly by the ranks of the vocabulary. Nothing is trained.
"""

from __future__ import annotations

import json
import os
import tempfile
from array import array
from bisect import bisect_left

import numpy as np
import regex
from pyspark import SparkFiles

from .word_cache import Memo

#: The pre-tokenizer's published pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: The rank of a pair that never merges.
NONE = 1 << 30


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character, by the byte-level rule: printable Latin-1 stands for itself, the rest moves up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in out)
    return out | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge ranks and added tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_alphabet().items()}
        raw = lambda s: bytes(back[c] for c in s)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.rank = {(raw(a), raw(b)): r for r, (a, b) in enumerate(spec["model"]["merges"])}
        self.one = [bytes([b]) for b in range(256)]
        self.bytes_of = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for t, i in self.ids.items():
            self.bytes_of[i] = t
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: the pair of the lowest rank is merged, leftmost first, until none is left."""
        if len(word) > 96:
            return self._merge_long([word[i : i + 1] for i in range(len(word))])
        one, pair = self.one, self.rank.get
        parts = [one[b] for b in word]
        ranks = [pair(p, NONE) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            at = ranks.index(best)
            parts[at] += parts.pop(at + 1)
            del ranks[at]
            if at < len(ranks):
                ranks[at] = pair((parts[at], parts[at + 1]), NONE)
            if at:
                ranks[at - 1] = pair((parts[at - 1], parts[at]), NONE)
        ids = self.ids
        return [ids[p] for p in parts]

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """The same with a heap, for words of many bytes."""
        import heapq

        n, rank = len(parts), self.rank
        nxt, prev = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, b""
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for x, y in ((prev[i], i), (i, nxt[i])):
                if x >= 0 and y >= 0 and (r := rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [self.ids[p] for p in parts if p]


def build_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool], int]:
    """Minimal acyclic automaton of sorted, different ``words``: (edges by state, final flags, root).

    Words are added in order; when a branch is finished, its states are replaced by equal registered ones from the end.
    """
    edges: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # (parent, byte, child) of the last word

    def settle(keep: int) -> None:
        while len(path) > keep:
            parent, byte, child = path.pop()
            key = (final[child], tuple(edges[child].items()))
            edges[parent][byte] = register.setdefault(key, child)

    last = b""
    for w in words:
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        settle(common)
        state = path[-1][2] if path else 0
        for b in w[common:]:
            edges.append({})
            final.append(False)
            edges[state][b] = len(edges) - 1
            path.append((state, b, len(edges) - 1))
            state = len(edges) - 1
        final[state] = True
        last = w
    settle(0)
    return edges, final, 0


class Lexicon:
    """The automaton as flat arrays in one int32 file: header, then first edge, words below, final, bytes, targets, skips, offsets, ids."""

    def __init__(self, flat: np.ndarray):
        sizes = [int(x) for x in flat[:8]]
        at, parts = 8, []
        for n in sizes:
            parts.append(memoryview(flat[at : at + n]))
            at += n
        self.first, self.final, self.byte, self.target, self.skip, self.offset, self.out, _ = parts

    @staticmethod
    def compile(entries: dict[bytes, list[int]]) -> np.ndarray:
        words = sorted(entries)
        edges, final, root = build_automaton(words)
        order, number = [root], {root: 0}
        for s in order:  # breadth first over what is reachable
            for t in edges[s].values():
                if t not in number:
                    number[t] = len(order)
                    order.append(t)
        below: dict[int, int] = {}
        stack = [(root, False)]
        while stack:
            s, done = stack.pop()
            if done:
                below[s] = final[s] + sum(below[t] for t in edges[s].values())
            elif s not in below:
                stack.append((s, True))
                stack += [(t, False) for t in edges[s].values() if t not in below]
        first, byte, target, skip = [0], [], [], []
        for s in order:
            seen = int(final[s])
            for b, t in sorted(edges[s].items()):
                byte.append(b)
                target.append(number[t])
                skip.append(seen)
                seen += below[t]
            first.append(len(byte))
        offset, out = [0], []
        for w in words:
            out += entries[w]
            offset.append(len(out))
        parts = [first, [int(final[s]) for s in order], byte, target, skip, offset, out, []]
        return np.concatenate([np.asarray([len(p) for p in parts], dtype="<i4"), *[np.asarray(p, dtype="<i4") for p in parts]])

    def find(self, word: bytes) -> list[int] | None:
        """The word's ids, or None."""
        state, index = 0, 0
        first, byte, target, skip = self.first, self.byte, self.target, self.skip
        for b in word:
            hi = first[state + 1]
            at = bisect_left(byte, b, first[state], hi)
            if at == hi or byte[at] != b:
                return None
            index += skip[at]
            state = target[at]
        return self.out[self.offset[index] : self.offset[index + 1]].tolist() if self.final[state] else None


def vocabulary_lexicon(vocab: Vocabulary, words: list[bytes] | None = None) -> np.ndarray:
    """Compiled lexicon: the vocabulary's own words (its frequent words, in order of frequency by construction) and ``words``."""
    entries = {}
    for w in [t for t in vocab.ids if len(t) > 1] + list(words or []):
        entries[w] = vocab.merge(w)
    return Lexicon.compile(entries)


def ship_lexicon(spark, vocab: Vocabulary, words: list[bytes] | None = None) -> str:
    """Compile the lexicon once and hand it to Spark's file distribution; returns the name under which executors find it."""
    flat = vocabulary_lexicon(vocab, words)
    folder = tempfile.mkdtemp(prefix="lexicon-")  # the driver's copy that Spark serves to executors
    name = f"lexicon-{os.path.basename(folder)}.bin"
    path = os.path.join(folder, name)
    flat.tofile(path)
    spark.sparkContext.addFile(path)
    return name


class Codec:
    """Exact encoder and decoder of whole texts."""

    CUT = regex.compile(r" \s| $")
    WORD = regex.compile(r"( ?\p{L}+)([^\s\p{L}\p{N}']+)")

    def __init__(self, tokenizer_path: str, lexicon: Lexicon | None = None):
        self.vocab = Vocabulary(tokenizer_path)
        self.lexicon = lexicon
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.vocab.special, key=len, reverse=True))) if self.vocab.special else None
        self.marks = list(self.vocab.special)
        self.words = Memo(self._word, 600_000)
        self.units = Memo(self._unit, 600_000)

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        found = self.lexicon.find(raw) if self.lexicon and len(raw) < 24 else None
        return array("I", self.vocab.merge(raw) if found is None else found).tobytes()

    def _unit(self, unit: str) -> bytes:
        if m := self.WORD.fullmatch(unit):
            return self.words[m[1]] + self.words[m[2]]
        return b"".join(self.words[w] for w in self.pattern.findall(unit))

    def _plain(self, text: str) -> bytes:
        if self.CUT.search(text):  # runs of white space are tokens of their own: pre-tokenized as a whole
            return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))
        head, *rest = text.split(" ")
        out = self.units[head] + b"".join([self.units[" " + r] for r in rest])
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, special tokens' strings included as in the tokenizers library."""
        if self.special and any(s in text for s in self.marks):
            blob, at = b"", 0
            for m in self.special.finditer(text):
                blob += self._plain(text[at : m.start()]) + np.asarray([self.vocab.special[m[0]]], dtype="<u4").tobytes()
                at = m.end()
            blob += self._plain(text[at:])
        else:
            blob = self._plain(text)
        self.words.trim()
        self.units.trim()
        return np.frombuffer(blob, dtype="<u4")

    def decode(self, ids) -> str:
        """Text of ids: their bytes joined, invalid UTF-8 replaced."""
        return b"".join(map(self.vocab.bytes_of.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")


_CODECS: dict = {}


def codec(tokenizer_path: str, lexicon_name: str | None) -> Codec:
    """This worker's codec; the lexicon's pages are mapped from the file that Spark shipped."""
    key = (tokenizer_path, lexicon_name)
    if key not in _CODECS:
        lexicon = Lexicon(np.memmap(SparkFiles.get(lexicon_name), dtype="<i4", mode="r")) if lexicon_name else None
        _CODECS[key] = Codec(tokenizer_path, lexicon)
    return _CODECS[key]
