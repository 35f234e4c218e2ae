"""Plain versions of the contracts, from texts in memory: what the operators are held against."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np

ASCII_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text: str | None, k: int = 5) -> set:
    w = ASCII_WORD.findall(lower_ascii(text or ""))
    return ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}) if w else set()


def smallest_reachable(ids, links) -> dict:
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_duplicates(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id)."""
    sets = {i: shingles(t) for i, t in docs}
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    shared: dict = defaultdict(int)
    for ids in index.values():
        for a, b in itertools.combinations(sorted(ids), 2):
            shared[a, b] += 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    comp = smallest_reachable(sets, links)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def digest(spans) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def secrets(text: str | None) -> dict[str, list[tuple[str, int, int]]]:
    text = text or ""
    found = {
        "assign": [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12],
        "access": [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18],
        "hex": [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16],
    }
    return found


def secrets_digest(text: str | None) -> str:
    found = secrets(text)
    order = ["assign", "access", "hex"]
    return digest(sorted(itertools.chain(*found.values()), key=lambda s: (s[1], order.index(s[0]))))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return out


def kept_words(docs: list[tuple[int, str | None]], window: int = 20) -> dict[int, tuple[int, int, str]]:
    """doc_id -> (n_words, n_removed, digest of the kept words)."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        w = ASCII_WORD.findall(text or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        left = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), len(w) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest())
    return out


def best(vectors: list[tuple[int, list | None]], k: int = 5) -> list[tuple[int, int, int, int]]:
    good = [(i, np.floor(256 * np.asarray(v, dtype=np.float64)).astype(np.int64)) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ids = np.array([i for i, _ in good])
    x = np.stack([v for _, v in good])
    out = []
    for i, q in good:
        if i % 50 == 0:
            score = x @ q
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out += [(i, r + 1, int(ids[j]), int(score[j])) for r, j in enumerate(order)]
    return sorted(out)


def vector_groups(vectors: list[tuple[int, list | None]], least: float = 0.95) -> dict[int, tuple[int, int]]:
    good = [(i, np.asarray(v, dtype=np.float64)) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = [i for i, _ in good]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))]
    comp = smallest_reachable([i for i, _ in vectors], links)
    n = dict(zip(ids, near.sum(axis=1).tolist()))
    return {i: (n.get(i, 0), comp[i]) for i, _ in vectors}


def archived(pages: list[tuple[int, str | None]]) -> list[tuple]:
    first: dict[bytes, int] = {}
    raw = [(i, (h or "").encode()) for i, h in pages]
    for i, p in sorted(raw):
        first.setdefault(p, i)
    out = []
    for i, p in raw:
        again = len(p) >= 100 and first[p] != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out)


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
