"""Firewall rules line by line, and what is wrong with them; spans that are put aside and back; tags of addresses; gaps and totals of logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ports that should not be open, with their service and how bad it is.
PORTS = {21: ("FTP", "medium"), 23: ("Telnet", "high"), 135: ("MSRPC", "high"), 139: ("NetBIOS", "high"), 445: ("SMB", "high"), 1433: ("MSSQL", "high"), 3306: ("MySQL", "high"), 3389: ("RDP", "high"), 5432: ("PostgreSQL", "high"), 6379: ("Redis", "high"), 27017: ("MongoDB", "high")}


def _option(line: Column, name: str) -> Column:
    """What follows an option; the pattern is tried only on lines that hold its letters."""
    found = F.when(F.contains(line, F.lit(name)), F.nullif(F.regexp_extract(line, rf"(?:^|\s){name}\s+(\S+)", 1), F.lit("")))
    return F.coalesce(found, F.lit("any"))


def firewall_rules(lines: DataFrame) -> DataFrame:
    """(file, line, type, chain, source, destination, protocol, port, action) of the policies and rules among iptables lines (file, line, content)."""
    c = F.trim("content")
    policy, rule = F.startswith(c, F.lit(":")), F.startswith(c, F.lit("-A"))
    rows = lines.where(policy | rule).select("file", "line", c.alias("c"), F.when(policy, "policy").otherwise("rule").alias("type"))
    of_rule = F.col("type") == "rule"
    c = F.col("c")
    target = F.regexp_extract(c, r"(?:^|\s)-j\s+(\S+)", 1)
    port = F.regexp_extract(c, r"(?:^|\s)--dport\s+(\S+)", 1)
    denied = F.when(of_rule, target.isin("DROP", "REJECT")).otherwise(F.regexp_extract(c, r"^:\S+\s+(\S+)", 1) == "DROP")
    return rows.select(
        "file", "line", "type", F.when(of_rule, F.regexp_extract(c, r"^-A\s+(\S+)", 1)).otherwise(F.regexp_extract(c, r"^:(\S+)", 1)).alias("chain"),
        *[F.when(of_rule, _option(c, o)).otherwise("any").alias(n) for o, n in (("-s", "source"), ("-d", "destination"), ("-p", "protocol"))],
        F.when(of_rule, F.nullif(port, F.lit(""))).alias("port"), F.when(denied, "deny").otherwise("permit").alias("action"),
    )


def rule_findings(rules: DataFrame) -> DataFrame:
    """(file, line, finding, severity): rules that permit anything to anything or a port of PORTS; files whose policies deny nothing by default (line 0)."""
    open_ = rules.where("type = 'rule' and action = 'permit'")
    number = F.expr("try_cast(regexp_extract(port, '^([0-9]+)', 1) as int)")
    listed = F.create_map(*[x for p, (s, v) in PORTS.items() for x in (F.lit(p), F.struct(F.lit(s).alias("service"), F.lit(v).alias("severity")))])
    kind = lambda finding, severity: F.struct(finding.alias("finding"), severity.alias("severity"))
    every = F.when((F.col("source") == "any") & (F.col("destination") == "any"), kind(F.lit("any_to_any"), F.lit("high")))
    port = F.when(F.col("p").isNotNull(), kind(F.concat(F.lit("port:"), F.col("p.service")), F.col("p.severity")))
    # Both in one pass over the rules.
    found = open_.withColumn("p", F.try_element_at(listed, number)).select("file", "line", F.explode(F.array_compact(F.array(every, port))).alias("f")).select("file", "line", "f.finding", "f.severity")
    policies = rules.where("type = 'policy'").groupBy("file").agg(F.bool_or((F.col("action") == "deny") & F.col("chain").isin("INPUT", "FORWARD")).alias("ok"))
    none = policies.where("not ok").select("file", F.lit(0).alias("line"), F.lit("no_default_deny").alias("finding"), F.lit("medium").alias("severity"))
    return found.unionByName(none)


def protected(text: Column, pattern: str, mark: str = "⦙") -> Column:
    """(text, spans): every match in place of a numbered mark, and the matches in order. The text must not hold the mark."""
    spans = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    marked = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(mark), i.cast("string"), F.lit(mark), p)))
    return F.struct(F.array_join(marked, "").alias("text"), spans.alias("spans"))


def restored(text: Column, spans: Column, mark: str = "⦙") -> Column:
    """The text with every numbered mark replaced by its span."""
    pieces = F.split(text, f"{mark}[0-9]+{mark}", -1)
    numbers = F.regexp_extract_all(text, F.lit(f"{mark}([0-9]+){mark}"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.coalesce(F.get(spans, F.get(numbers, i - 1).cast("int") - 1), F.lit("")), p))), "")


def address_tags(address: Column) -> Column:
    """Tags of an address: its extension, and the parts of its path that are words."""
    path = F.regexp_replace(F.coalesce(address, F.lit("")), r"^[a-z]+://[^/]*|[?#].*$", "")
    extension = F.nullif(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), F.lit(""))
    parts = F.filter(F.split(F.lower(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")), r"[/_.-]+"), lambda p: F.rlike(p, F.lit("^[a-z]{3,}$")))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(extension), parts))))


def gaps(rows: DataFrame, by: str, ts: str, longest: int) -> DataFrame:
    """(by, start, seconds) of silences of more than ``longest`` seconds between rows that follow each other."""
    w = Window.partitionBy(by).orderBy(ts)
    seconds = F.unix_timestamp(F.lead(ts).over(w)) - F.unix_timestamp(ts)
    return rows.where(F.col(ts).isNotNull()).select(by, F.col(ts).alias("start"), seconds.alias("seconds")).where(F.col("seconds") > longest)


def density(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, of_row, of_all): counts of pairs and their shares of the row and of the largest cell."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    per_row = F.sum("n").over(Window.partitionBy(a))
    top = cells.agg(F.max("n").alias("top"))
    return cells.withColumn("of_row", F.col("n") / per_row).crossJoin(F.broadcast(top)).select(a, b, "n", "of_row", (F.col("n") / F.col("top")).alias("of_all"))  # one row


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``work`` whose key is not among those done."""
    return work.join(done.select(key).distinct(), key, "left_anti")
