"""Secret scans: base formats by pattern, further ones by probabilistic automata inferred from labelled credentials.

Grammar inference: the labelled credentials of a kind make a prefix tree of symbol counts; states whose futures are
statistically compatible (Hoeffding bound on every symbol's and the end's frequency, recursively) are merged in
breadth-first order, which turns the tree into a probabilistic automaton. Every candidate token of a text, and every part
of it between separators, is scored by its log likelihood for each format, over that of ordinary tokens, by symbol. The automata are small and fixed in
size; they are inferred once on the driver from a bounded labelled sample and go to the tasks with the code.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
SEPARATORS = "+/_.=-"
SHORTEST = 16  # characters of a candidate
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "format")
LABELLED = 150  # labelled credentials of each kind
THRESHOLD = 1.2  # bits a symbol over an ordinary token
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def labelled_credentials(seed: int = 7, per_kind: int = LABELLED) -> dict[str, list[str]]:
    """Credentials of public formats, labelled by kind, made by rule."""
    r = random.Random(seed)
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    hexes, upper = "0123456789abcdef", _ALNUM[:26] + "0123456789"
    make = {
        "access": lambda: "AKIA" + some(upper, 16),
        "hex": lambda: some(hexes, r.choice((32, 40, 64))),
        "forge": lambda: r.choice(("ghp_", "gho_", "ghs_")) + some(_ALNUM, 36),
        "chat": lambda: r.choice(("xoxb", "xoxp")) + f"-{some('0123456789', 12)}-{some('0123456789', 12)}-{some(_ALNUM, 24)}",
        "maps": lambda: "AIza" + some(_ALNUM + "-_", 35),
        "pay": lambda: r.choice(("sk_live_", "rk_live_")) + some(_ALNUM, 24),
        "jwt": lambda: "eyJ" + some(_ALNUM, 33) + ".eyJ" + some(_ALNUM, 40) + "." + some(_ALNUM + "-_", 43),
    }
    return {k: [f() for _ in range(per_kind)] for k, f in make.items()}


def symbols(token: str) -> list[str]:
    """The first four characters as they are, the others by class."""
    return [*token[:4], *("d" if c in "0123456789" else "x" if c in "abcdef" else "l" if c.islower() else "u" if c.isupper() else c for c in token[4:])]


def _class(c: str) -> str:
    return "d" if c in "0123456789" else "x" if c in "abcdef" else "l" if c.islower() else "u" if c.isupper() else c


class Automaton:
    """Probabilistic automaton from a prefix tree with compatible states merged."""

    def __init__(self, sample: list[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends = [0]
        self.total = [0]
        for token in sample:
            s = 0
            self.total[0] += 1
            for c in symbols(token):
                if c not in self.next[s]:
                    self.next[s][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                    self.total.append(0)
                self.count[s][c] = self.count[s].get(c, 0) + 1
                s = self.next[s][c]
                self.total[s] += 1
            self.ends[s] += 1
        self.least = -math.inf  # score that a token must reach, see automata()
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if self._differ(self.ends[a], self.total[a], self.ends[b], self.total[b]):
                return False
            for c in {*self.count[a], *self.count[b]}:
                if self._differ(self.count[a].get(c, 0), self.total[a], self.count[b].get(c, 0), self.total[b]):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    stack.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree under b to the automaton at a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.ends[a] += self.ends[b]
            self.total[a] += self.total[b]
            for c, t in self.next[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + self.count[b][c]
                if c in self.next[a]:
                    stack.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _infer(self) -> None:
        red, blue = [0], [(0, c) for c in self.next[0]]
        while blue:
            parent, c = blue.pop(0)
            state = self.next[parent][c]
            for r in red:
                if self._compatible(r, state):
                    self.next[parent][c] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
            known = set(red)
            blue = [(p, c) for p in red for c, t in self.next[p].items() if t not in known]
        self.states = len(red)

    def step(self, state: int, symbol: str) -> tuple[int, float] | None:
        """Next state and the symbol's bits. Where labelled credentials vary freely, an unseen character goes the way of one of its class."""
        to = self.next[state].get(symbol)
        if to is None and len(self.next[state]) > FREE:
            to = next((t for c, t in self.next[state].items() if _class(c) == _class(symbol)), None)
        if to is None:
            return None
        return to, math.log2((self.count[state].get(symbol, 0) + 0.01) / (self.total[state] + 1))

    def ends_of(self, token: str, start: int = 0) -> list[tuple[int, float]]:
        """(end, score in bits a symbol over an ordinary token) of the parts from ``start`` to a separator or the token's end."""
        state, bits, base, out = 0, 0.0, 0.0, []
        for i in range(start, len(token)):
            c = _class(token[i])
            literal = i < start + 4
            if (to := self.step(state, token[i] if literal else c)) is None:
                break
            state, bits, base = to[0], bits + to[1], base + ORDINARY.get(c, -6.0) - (SIZE.get(c, 0.0) if literal else 0.0)
            if token[i] not in "./" and (i + 1 == len(token) or token[i + 1] in SEPARATORS):
                end = math.log2((self.ends[state] + 0.01) / (self.total[state] + 1))
                out.append((i + 1, (bits + end - base) / (i + 1 - start)))
        return out


@lru_cache(maxsize=1)
def automata() -> dict[str, Automaton]:
    """One automaton for each kind of labelled credential; it accepts what scores like the least of its own sample, or THRESHOLD."""
    out = {}
    for kind, sample in labelled_credentials().items():
        out[kind] = Automaton(sample)
        out[kind].least = min(THRESHOLD, *(out[kind].ends_of(token)[-1][1] for token in sample))
    return out


#: Bits of a symbol in ordinary long tokens (addresses, words run together): letters are common, others rare.
ORDINARY = {"d": -4.0, "x": -2.0, "l": -1.2, "u": -4.5}
#: Bits of one character within its class, for the first four, which count as they are.
SIZE = {"d": math.log2(10), "x": math.log2(6), "l": math.log2(20), "u": math.log2(26)}
FREE = 12  # different symbols after which a state's next one is free


def _longest(token: str, start: int, model: Automaton) -> int:
    """End of the longest part from ``start`` that the model accepts, or 0."""
    return max((end for end, score in model.ends_of(token, start) if end - start >= SHORTEST and score >= model.least), default=0)


def credentials(token: str, models: dict[str, Automaton]) -> list[tuple[int, int]]:
    """Parts of a candidate that some format accepts, from its start or after a separator: leftmost first, longest first."""
    out, taken = [], 0
    for start in [0, *(i + 1 for i, c in enumerate(token) if c in SEPARATORS)]:
        if start >= taken and len(token) - start >= SHORTEST:
            end = max(_longest(token, start, m) for m in models.values())
            if end:
                out.append((start, end))
                taken = end
    return out


def find_spans(text: str, models: dict[str, Automaton]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of a text: all base spans, and format spans that overlap none of them; by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    base = None
    for m in CANDIDATE.finditer(text):
        token, at = m[0], m.start()
        for h in HEX.finditer(token):
            out.append((at + h.start(), at + h.end(), "hex"))
        if base is None:
            base = [s for s in out if s[2] != "hex"]
        out += [(at + a, at + b, "format") for a, b in credentials(token, models)]
    if not out:
        return out
    solid = [s for s in out if s[2] != "format"]
    out = solid + [f for f in out if f[2] == "format" and not any(s[0] < f[1] and f[0] < s[1] for s in solid)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span, overlapping ones together, replaced by a mark of its kind."""
    merged: list[list] = []
    for a, b, kind in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, kind])
    out, at = [], 0
    for a, b, kind in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame, redacted: bool = True) -> DataFrame:
    """``docs`` with ``secrets`` (array of start, end, kind; code points, end exclusive) and ``redacted_text``.

    All other columns are kept (columns of those two names are replaced). A null text is an empty one: no secrets, an
    empty redacted text. Each row is handled on its own, so repeated rows, ties and extra columns need nothing more; an
    empty table gives an empty result. With ``redacted`` false the text and the redacted text are left out.
    """
    models = automata()
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("secrets", "redacted_text") and (redacted or c != "text")]
    rows = docs.select(F.struct(*keep).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            found = [find_spans(t, models) for t in texts]
            cols = [batch.column("_row"), pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in f] for f in found], kind)]
            if redacted:
                cols.append(pa.array([redact(t, f) if f else t for t, f in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["_row", "secrets", "redacted_text"][: len(cols)])

    fields = [T.StructField("_row", rows.schema["_row"].dataType), T.StructField("secrets", span), T.StructField("redacted_text", T.StringType())]
    out = rows.mapInArrow(run, T.StructType(fields[: 2 + redacted]))
    return out.select("_row.*", "secrets", *["redacted_text"] * redacted)
