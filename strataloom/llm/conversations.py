"""Repair of the turn structure of conversations at the least cost, as a fold over their turns.

A conversation should run ``s?(ua)+`` by the initials of its roles, or be empty. Window functions and a grouped minimum flag
each turn's fault; turns are collected, sorted, as structs, and ``aggregate`` carries four structs (cost, audit) over them,
one for each state: nothing yet, after the system turn, after a user turn, after an assistant turn. Every step takes native
``least`` over structs, so of equal costs the least audit stays. That is sound: two audits of equal cost that end in one
state are never one the start of the other, as more letters over the same turns are insertions and cost more.

A conversation of any length is folded in blocks of turns. A block is folded from each of the four states it may start in;
blocks of a conversation are then folded the same way, over matrices in place of turns, 64 at a time, and the path through
the states says which of its audits each block takes. What must be whole in one place is what is returned whole: an audit
is one value, and a digest of all repaired turns reads them in order, as a stream.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Cuts

SPACE = "\\x20\\x09-\\x0D"
BLOCK = 256  # turns folded as one
FAN = 64  # blocks folded as one
RULE, DELETE, INSERT, OPEN = 3, 4, 3, 3  # costs of another role, a deletion, an insertion, and of a truncated turn that stays
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
_STEP, _LINK = "struct<cost:bigint,audit:string>", "struct<cost:bigint,audit:string,path:string>"
STATES = range(4)


def _more(at: Column, letters: str, cost) -> Column:
    """``at`` with another edit; null where that state is not reached."""
    return F.when(at.isNotNull(), F.struct((at["cost"] + cost).cast("long").alias("cost"), F.concat(at["audit"], F.lit(letters)).alias("audit")))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _states(values) -> Column:
    return F.struct(*(v.alias(f"s{i}") for i, v in enumerate(values)))


def _start(state: Column, kind: str) -> Column:
    zero = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"), *([F.lit("").alias("path")] if kind == _LINK else []))
    return _states(F.when(state == i, zero) for i in STATES)


def _from_each(fold) -> Column:
    """What ``fold`` gives from each state, as an array."""
    return F.transform(F.array(*map(F.lit, STATES)), lambda s: fold(s))


def _inserted(v: Column) -> list[Column]:
    """States after any insertions that can be worth it."""
    s = [v[f"s{i}"] for i in STATES]
    return [s[0], s[1], F.least(s[2], *(_more(s[i], "I", INSERT) for i in (0, 1, 3))), F.least(s[3], _more(s[2], "I", INSERT), *(_more(s[i], "II", 2 * INSERT) for i in (0, 1)))]


def _turn(v: Column, t: Column) -> Column:
    """States after one turn: it is kept, gets another role or is deleted."""
    extra = F.when(t["fault"] == TRUNCATED, OPEN).otherwise(0)
    stays = t["fault"].isin(NONE, TRUNCATED)
    as_is = lambda initial, s: F.when(stays & (t["initial"] == initial), _more(s, "K", extra))
    other = lambda s: F.when(stays, _more(s, "R", extra + RULE))

    def step(c):
        s = [c[f"s{i}"] for i in STATES]
        gone = [_more(x, "D", DELETE) for x in s]
        before_user = [s[0], s[1], s[3]]
        return _states([gone[0], F.least(gone[1], as_is("s", s[0])), F.least(gone[2], *(as_is("u", x) for x in before_user), *(other(x) for x in before_user)), F.least(gone[3], as_is("a", s[2]), other(s[2]))])

    return _let(_states(_inserted(v)), step)


def _folded(turns: Column) -> Column:
    """From each state a block may start in, the least edits to each it may end in."""
    def of(start: Column) -> Column:
        way = lambda at: F.when(at.isNotNull(), F.struct(at["cost"].alias("cost"), at["audit"].alias("audit"), start.cast("string").alias("path")))
        return _let(F.aggregate(turns, _start(start, _STEP), _turn), lambda v: _states(way(v[f"s{i}"]) for i in STATES))

    return _from_each(of)


def _joined(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit"), F.concat(a["path"], b["path"]).alias("path")))


def _chained(ways: Column) -> Column:
    """Matrices of consecutive blocks as one."""
    step = lambda v, w: _states(F.least(*(_joined(v[f"s{m}"], w[m][f"s{e}"]) for m in STATES)) for e in STATES)
    return _from_each(lambda s: F.aggregate(ways, _start(s, _LINK), step))


def _best(v: Column) -> Column:
    """The least way that ends well, and as the last figure of its path the state before insertions at the end."""
    s = [F.when(v[f"s{i}"].isNotNull(), F.struct(v[f"s{i}"]["cost"].alias("cost"), v[f"s{i}"]["audit"].alias("audit"), F.concat(v[f"s{i}"]["path"], F.lit(str(i))).alias("path"))) for i in STATES]
    more = lambda x, letters: F.when(x.isNotNull(), F.struct((x["cost"] + INSERT * len(letters)).alias("cost"), F.concat(x["audit"], F.lit(letters)).alias("audit"), x["path"].alias("path")))
    return F.least(s[0], s[3], more(s[2], "I"), more(s[1], "II"))


def _broken(a: Column, b: Column) -> Column:
    """1 where two initials may not follow each other; 0 where one is missing."""
    return F.when(a.isNotNull() & b.isNotNull() & ~F.concat(a, b).isin("su", "ua", "au"), 1).otherwise(0)


def _counted(blocks: Column) -> Column:
    """Counts of consecutive blocks as one: faults add up, a turn or a break across an edge is seen from both sides."""
    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("turns", "blank", "duplicate", "truncated", "illegal")), *(F.lit(None).cast("long").alias(c) for c in ("low", "high")), *(F.lit(None).cast("string").alias(c) for c in ("first", "last")))

    def step(a, b):
        same = F.when(a["high"] == b["low"], 1).otherwise(0)
        edge = _broken(a["last"], b["first"])
        plus = [(a[c] + b[c] - (same if c == "turns" else 0) + (edge if c == "illegal" else 0)).cast("long").alias(c) for c in ("turns", "blank", "duplicate", "truncated", "illegal")]
        return F.struct(*plus, F.least(a["low"], b["low"]).alias("low"), F.greatest(a["high"], b["high"]).alias("high"), F.coalesce(a["first"], b["first"]).alias("first"), F.coalesce(b["last"], a["last"]).alias("last"))

    return F.aggregate(blocks, zero, step)


def _lines(turns: Column, audit: Column, start: Column) -> Column:
    """The turns that a block's edits leave."""
    zero = F.struct(F.lit(0).alias("i"), start.alias("s"), F.array().cast("array<struct<role:string,text:string>>").alias("out"))

    def step(at, letter):
        turn = F.get(turns, at["i"])
        made = F.when(at["s"] == 2, F.lit("assistant")).otherwise(F.lit("user"))
        role, text = F.when(letter == "K", turn["role"]).otherwise(made), F.when(letter == "I", F.lit("")).otherwise(turn["text"])
        to = F.when(letter == "D", at["s"]).when((letter == "K") & (turn["initial"] == "s"), 1).when(at["s"] == 2, 3).otherwise(2)
        line = F.when(letter == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(F.struct(role.alias("role"), text.alias("text"))))
        return F.struct((at["i"] + F.when(letter == "I", 0).otherwise(1)).alias("i"), to.alias("s"), F.concat(at["out"], line).alias("out"))

    return F.aggregate(F.filter(F.split(audit, ""), lambda c: c != ""), zero, step)["out"]


class Repair:
    """``found`` (a row for each conversation) and ``turns`` (the repaired turns, in arrays of consecutive ones)."""

    def __init__(self, found: DataFrame, turns: DataFrame):
        self.found, self.turns = found, turns

    def rows(self) -> DataFrame:
        """(conv_id, place, role, text): a row for each repaired turn; places ascend but are not gapless."""
        return self.turns.select("conv_id", "at", F.posexplode("lines").alias("p", "line")).select("conv_id", (F.col("at") * (4 * BLOCK) + F.col("p")).alias("place"), "line.role", "line.text")

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256): of ``role:text`` lines, joined by newlines. A conversation is read as a stream."""
        text = F.array_join(F.transform("lines", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
        parts = int(self.turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = self.turns.select("conv_id", "at", text.alias("text")).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "at")
        return dealt.mapInArrow(_digested, "conv_id long, repaired_sha256 string")


def _digested(batches):
    done = lambda c, h: pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([h.hexdigest()])], names=["conv_id", "repaired_sha256"])
    conv, total = (), None
    for batch in batches:
        for c, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if (c,) != conv:
                if conv:
                    yield done(conv[0], total)
                conv, total, some = (c,), hashlib.sha256(), False
            if text:
                total.update((("\n" if some else "") + text).encode("utf-8", "surrogatepass"))
                some = True
    if conv:
        yield done(conv[0], total)


def repair(rows: DataFrame) -> Repair:
    """Faults, and the cheapest edits that give each conversation's roles the form ``(s?(ua)+)?``, of ``rows`` (conv_id, turn, role, text).

    A turn's fault is the first that holds: blank (nothing but ASCII white space), duplicate (role and text seen before in
    the conversation), truncated (its last other character is none of ``.!?``). Edits, with their letters and costs: keep K
    0, another role (user or assistant) R 3, delete D 4, insert an empty user or assistant turn I 3; blank and duplicate
    turns must go, a truncated one that stays adds 3. Of equal costs the least audit in ASCII is taken. ``found`` has conv_id,
    gaps, blank, duplicate, truncated, illegal, cost, audit.

    Turns go by turn (nulls first), then role and text; rows that repeat are turns of their own. A null role or text is one
    space, a null conv_id is a conversation. A null turn counts for no gap. Long texts are only moved. Other columns are not
    looked at. No rows, no conversations.
    """
    spark = rows.sparkSession
    cuts = Cuts(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), of("role"), of("text"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id())
    rows = cuts.written(rows, "conv-turns").withColumn("blank", ~F.col("text").rlike(f"[^{SPACE}]"))

    # Faults: the first turn of each role and text has its own place as the smallest one.
    firsts = rows.where("not blank").groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("m").alias("m")).select("m", F.lit(True).alias("is_first"))
    ended = F.col("text").rlike(f"[.!?][{SPACE}]*\\z")
    fault = F.when(F.col("blank"), BLANK).when(F.col("is_first").isNull(), DUPLICATE).when(~ended, TRUNCATED).otherwise(NONE)
    flagged = rows.join(firsts, "m", "left").withColumn("fault", fault).withColumn("initial", F.substring("role", 1, 1))

    # Blocks of consecutive turns, by place in the sorted order: part and place number them over all.
    keys = ["conv_id", "pid", "b"]
    place = F.col("m").bitwiseAND((1 << 33) - 1)
    bits = ((rows.agg(F.max(place)).first()[0] or 0) // BLOCK).bit_length()
    flagged = flagged.withColumn("pid", F.shiftright("m", 33)).withColumn("b", F.floor(place / BLOCK))
    here = Window.partitionBy(*keys).orderBy("m")
    before = F.lag("turn").over(here)
    new = (F.col("turn").isNotNull() & (before.isNull() | (before != F.col("turn")))).cast("long")
    flagged = flagged.withColumn("new", new).withColumn("broken", _broken(F.lag("initial").over(here), F.col("initial")))
    count = lambda what, name: F.sum(what.cast("long")).alias(name)
    counts = [count(F.col("new"), "turns"), *(count(F.col("fault") == k, name) for k, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))), count(F.col("broken"), "illegal")]
    ends = [F.min("turn").alias("low"), F.max("turn").alias("high"), F.min_by("initial", "m").alias("first"), F.max_by("initial", "m").alias("last")]
    turns = F.sort_array(F.collect_list(F.struct("m", "fault", "initial", "role", "text")))
    blocks = flagged.groupBy(*keys).agg(*counts, *ends, turns.alias("list"))
    stats = F.struct("turns", "blank", "duplicate", "truncated", "illegal", "low", "high", "first", "last")
    blocks = blocks.select("conv_id", (F.shiftleft(F.col("pid"), bits) + F.col("b")).alias("at"), stats.alias("stats"), _folded(F.col("list")).alias("ways"), F.col("list"))
    blocks = cuts.written(blocks, "conv-blocks")

    # Blocks of a conversation as one, 64 neighbours at a time while there are more.
    level = blocks.select("conv_id", F.col("at").alias("g"), F.array("at").alias("ats"), "stats", "ways")
    many = lambda d: (d.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0) > FAN

    def merged(d: DataFrame, *by: Column) -> DataFrame:
        together = F.sort_array(F.collect_list(F.struct(F.col("g").alias("o"), "ats", "stats", "ways")))
        got = d.groupBy("conv_id", *by).agg(together.alias("x"))
        each = lambda name: F.transform("x", lambda b: b[name])
        return got.select("conv_id", *(["g"] if by else []), F.flatten(each("ats")).alias("ats"), _counted(each("stats")).alias("stats"), _chained(each("ways")).alias("ways"))

    while many(level):
        level = cuts.written(merged(level, F.shiftright("g", FAN.bit_length() - 1).alias("g")), "conv-level")
    whole = merged(level).withColumn("best", _best(F.col("ways")[0])).drop("ways")
    whole = cuts.written(whole, "conv-found")

    s = F.col("stats")
    found = whole.select("conv_id", F.coalesce(s["high"] - s["low"] + 1 - s["turns"], F.lit(0)).cast("long").alias("gaps"), *(s[c].alias(c) for c in ("blank", "duplicate", "truncated", "illegal")), F.col("best")["cost"].alias("cost"), F.col("best")["audit"].alias("audit"))
    way = whole.select(F.col("conv_id").alias("c"), F.col("best")["path"].alias("path"), F.posexplode("ats").alias("i", "at"))
    digit = lambda k: F.substring(F.col("path"), F.col("i") + k, F.lit(1)).cast("int")
    way = way.select("c", F.col("at").alias("a"), digit(1).alias("start"), digit(2).alias("end"), (F.length("path") == F.col("i") + 2).alias("ends"))
    taken = blocks.join(way, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("a")))
    ends_in = F.get("ways", F.col("start"))
    audit = F.coalesce(*(F.when(F.col("end") == e, ends_in[f"s{e}"]["audit"]) for e in STATES))
    empty = lambda *roles: F.array(*(F.struct(F.lit(r).alias("role"), F.lit("").alias("text")) for r in roles)).cast("array<struct<role:string,text:string>>")
    tail = F.when(F.col("ends") & (F.col("end") == 1), empty("user", "assistant")).when(F.col("ends") & (F.col("end") == 2), empty("assistant")).otherwise(empty())
    taken = taken.withColumn("audit", audit)
    lines = F.concat(_lines(F.col("list"), F.col("audit"), F.col("start")), tail)
    return Repair(found, cuts.written(taken.select("conv_id", "at", lines.alias("lines")), "conv-lines"))
