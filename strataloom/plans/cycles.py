"""Queries: strong parts and cycles of the whole graph of parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import cycles as C
from strataloom.sources.tables import table


def _flows(spark, sf):
    """Parts to their suppliers, and back for returned lines."""
    p, s = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    back = F.col("l_returnflag") == "R"
    return table(spark, sf, "lineitem").select(F.when(back, s).otherwise(p).alias("src"), F.when(back, p).otherwise(s).alias("dst")).distinct()


def supply_cycles(spark, sf):
    """Nodes on cycles, by their strong part."""
    return C.on_cycles(_flows(spark, sf))


def supply_witnesses(spark, sf):
    """A shortest cycle of each strong part."""
    flows = _flows(spark, sf)
    return C.witnesses(flows, C.strong_parts(flows))


QUERIES = [supply_cycles, supply_witnesses]

#: No twins: a closure of the whole graph is too slow in SQL; held against plain walks.
SQL: dict[str, str] = {}
