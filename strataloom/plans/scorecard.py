"""Queries: document scorecards, flows and modules by volume, drift classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import scorecard as C
from strataloom.sources.tables import table

from . import documents as D
from . import sql as S


def doc_scorecard(spark, sf):
    return C.scorecard(table(spark, sf, "documents")).withColumn("tags", F.array_join("tags", ","))


def scorecard_summary(spark, sf):
    return C.scorecard_summary(C.scorecard(table(spark, sf, "documents"))).withColumns({c: F.round(c, 4) for c in ("lq", "sq", "ir", "mri", "sri")})


def _flows(spark, sf):
    """Parts as flows: all they sold is a day's volume."""
    sold = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("name")).agg((F.sum("l_quantity") * 1000).alias("volume_day"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("name"), (F.col("p_size") % 24).alias("first"), (F.col("p_size") * 7 % 24).alias("last"), (1 + F.col("p_size") % 5).alias("multiplier"))
    return C.flows(sold.join(part, "name"), 2_000_000)


def volume_flows(spark, sf):
    return _flows(spark, sf)


def volume_modules(spark, sf):
    members = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("module"), F.when(F.col("l_suppkey") % 10 == 0, "gateway").otherwise("worker").alias("role"), F.col("l_partkey").alias("flow")).distinct()
    return C.modules(members, _flows(spark, sf))


def drift_classes(spark, sf):
    """Customers' last orders as changes of code, those finished as documents."""
    days = lambda c: F.datediff(F.lit("1999-01-01").cast("date"), F.max(c).cast("date"))
    both = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("component")).agg(days(F.col("o_orderdate")).alias("days_code"), days(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("days_doc"))
    return C.drift_classes(both).withColumn("gap", F.round("gap", 6))


QUERIES = [doc_scorecard, scorecard_summary, volume_flows, volume_modules, drift_classes]


def _count(pattern: str) -> str:
    """Whole words by Unicode letters: what is no letter is doubled first, so that matches side by side share none."""
    return f"len(regexp_extract_all(w, {S.q('(?i)[^\\p{L}\\p{N}_](?:' + pattern.replace(' ', '  ') + ')[^\\p{L}\\p{N}_]')}))"


_SUMS = ", ".join(f"{' + '.join(_count(p) for p in many)} AS {k}" for k, many in C.INTENT.items())
_TOTAL = " + ".join(C.INTENT)
_CARDS = rf"""q AS ({D.SQL["doc_quality"].replace("round(lexical, 6)", "lexical").replace("round(regularity, 6)", "regularity").replace("round(completeness, 6)", "completeness").replace("round(CASE WHEN words < 10", "(CASE WHEN words < 10").replace("END, 6) AS quality", "END) AS quality")}),
t AS (SELECT doc_id, coalesce(text, '') AS t, ' ' || regexp_replace(coalesce(text, ''), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') || ' ' AS w FROM documents),
p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '\n\s*\n'), lambda p: length(regexp_replace(p, '^\s+|\s+$', '', 'g'))), lambda n: n > 20) AS ps, len(regexp_extract_all(t, '\S+')) AS nw, {_count(C.ACTIONS)} AS na, {_SUMS},
 regexp_matches(t, '(?m)^#\s+') AS h1, regexp_matches(t, '(?m)^##\s+') AS h2, regexp_matches(t, '(?m)^###\s+') AS h3, (len(regexp_extract_all(t, '(?m)^[ \t]*[-*•][ \t]+')) + len(regexp_extract_all(t, '(?m)^[ \t]*[0-9]+[.)][ \t]+'))) / len(string_split(t, chr(10)))::DOUBLE AS r FROM t),
s AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE 0.25::DOUBLE * CASE WHEN len(ps) > 1 THEN len(list_filter(ps, lambda n: n BETWEEN 100 AND 500)) / len(ps)::DOUBLE ELSE 0.5 END
 + 0.35::DOUBLE * (CASE WHEN h1 THEN 0.3 ELSE 0 END + CASE WHEN h2 THEN 0.3 ELSE 0 END + CASE WHEN h1 AND h2 THEN 0.2 ELSE 0 END + CASE WHEN h2 AND h3 THEN 0.2 ELSE 0 END)::DOUBLE + 0.4::DOUBLE * CASE WHEN r BETWEEN 0.1 AND 0.4 THEN 1.0 WHEN r < 0.1 THEN 0.7 ELSE greatest(0::DOUBLE, 1 - (r - 0.4) * 2) END::DOUBLE END AS sq,
 CASE WHEN nw > 0 THEN least(1::DOUBLE, na / nw::DOUBLE * 100 / 5) ELSE 0 END AS actions, {_TOTAL} AS total FROM p),
e AS (SELECT *, CASE WHEN total > 0 THEN ({" + ".join(f"CASE WHEN {k} > 0 THEN -({k} / total::DOUBLE) * log2({k} / total::DOUBLE) ELSE 0 END" for k in C.INTENT)}) / 2 ELSE 1 END AS entropy, greatest({", ".join(C.INTENT)}) / total::DOUBLE AS top FROM s),
i AS (SELECT *, CASE WHEN total = 0 THEN 0.5 WHEN top >= 0.8 THEN least(1::DOUBLE, 1.1::DOUBLE - entropy) ELSE 1 - entropy END::DOUBLE AS ir FROM e),
c AS (SELECT doc_id, round(quality, 6) AS lq, round(sq, 6) AS sq, round(ir, 6) AS ir, round(entropy, 6) AS entropy, round(actions, 6) AS actions, round(0.35::DOUBLE * quality + 0.25::DOUBLE * sq + 0.25::DOUBLE * (1 - entropy) + 0.15::DOUBLE * actions, 6) AS mri,
 round(0.3::DOUBLE * quality + 0.3::DOUBLE * sq + 0.1::DOUBLE + 0.2::DOUBLE * ir, 6) AS sri, round(0.25::DOUBLE * quality + 0.2::DOUBLE * sq + 0.175::DOUBLE + 0.2::DOUBLE * ir, 6) AS qa FROM i JOIN q USING (doc_id))"""
_FLOWS = """f AS (SELECT l_partkey AS name, sum(l_quantity) * 1000 AS volume_day FROM lineitem GROUP BY 1), g AS (SELECT f.*, p_size % 24 AS first, p_size * 7 % 24 AS last, 1 + p_size % 5 AS multiplier, (p_size * 7 % 24 - p_size % 24 + 24) % 24 AS h FROM f JOIN part ON name = p_partkey),
w AS (SELECT *, volume_day / 86400 AS m, CASE WHEN h > 0 THEN volume_day / (h * 3600) ELSE volume_day / 86400 END AS r FROM g),
o AS (SELECT name, volume_day, first, last, multiplier, round(m, 6) AS mean_rate, round(r, 6) AS window_rate, round(r * multiplier, 6) AS peak_rate, round(least(10::DOUBLE, volume_day / 2000000 * 10), 6) AS score FROM w)"""
SQL = {
    "doc_scorecard": f"""WITH {_CARDS} SELECT *, coalesce(array_to_string(list_filter([CASE WHEN sq >= 0.7 THEN 'well_structured' WHEN sq < 0.4 THEN 'needs_structure' END, CASE WHEN lq >= 0.7 THEN 'high_linguistic_quality' WHEN lq < 0.4 THEN 'low_linguistic_quality' END, CASE WHEN entropy < 0.3 THEN 'clear_intent' WHEN entropy >= 0.5 THEN 'mixed_intent' END,
 CASE WHEN mri >= 0.75 THEN 'minutes_ready' WHEN mri < 0.45 THEN 'minutes_needs_rewrite' END, CASE WHEN sri >= 0.7 THEN 'summary_ready' WHEN sri < 0.5 THEN 'summary_unsuitable' END], lambda x: x IS NOT NULL), ','), '') AS tags FROM c""",
    "scorecard_summary": f"""WITH {_CARDS} SELECT count(*) AS documents, round(avg(lq), 4) AS lq, round(avg(sq), 4) AS sq, round(avg(ir), 4) AS ir, round(avg(mri), 4) AS mri, round(avg(sri), 4) AS sri, count(*) FILTER (mri >= 0.75) AS minutes_ready, count(*) FILTER (sri >= 0.7) AS summary_ready, count(*) FILTER (mri < 0.45 AND sri < 0.5) AS attention,
 count(*) FILTER (mri >= 0.75) AS excellent, count(*) FILTER (mri >= 0.6 AND mri < 0.75) AS good, count(*) FILTER (mri >= 0.45 AND mri < 0.6) AS acceptable, count(*) FILTER (mri < 0.45) AS poor FROM c""",
    "volume_flows": f"WITH {_FLOWS} SELECT * FROM o",
    "volume_modules": f"""WITH {_FLOWS}, m AS (SELECT DISTINCT l_suppkey AS module, CASE WHEN l_suppkey % 10 = 0 THEN 'gateway' ELSE 'worker' END AS role, l_partkey AS flow FROM lineitem), a AS (SELECT module, role, count(*) AS flows, sum(volume_day) AS volume_day, max(peak_rate) AS peak_rate FROM m JOIN o ON flow = name GROUP BY 1, 2)
SELECT *, CASE WHEN role = 'gateway' OR peak_rate > 500 THEN 'CRITICAL' WHEN volume_day > 1000000 OR peak_rate > 100 THEN 'HIGH' WHEN volume_day > 100000 OR peak_rate > 50 THEN 'MEDIUM' ELSE 'LOW' END AS criticality FROM a""",
    "drift_classes": """WITH d AS (SELECT o_custkey AS component, date_diff('day', max(o_orderdate)::DATE, DATE '1999-01-01')::INT AS days_code, date_diff('day', (max(o_orderdate) FILTER (o_orderstatus = 'F'))::DATE, DATE '1999-01-01')::INT AS days_doc FROM orders GROUP BY 1),
g AS (SELECT *, coalesce(greatest(days_doc - days_code, 0), 0)::INT AS drift_days FROM d), k AS (SELECT *, CASE WHEN days_doc IS NULL THEN 'undocumented_changes' WHEN days_code < 180 AND days_doc < 180 AND drift_days < 30 THEN 'synchronized' WHEN days_code < 180 THEN 'undocumented_changes' WHEN days_doc < 180 THEN 'spec_ahead_of_code' ELSE 'stable' END AS drift FROM g)
SELECT *, CASE WHEN days_doc IS NULL THEN 'warning' WHEN days_code < 180 AND days_doc >= 180 AND drift_days > 180 THEN 'error' WHEN drift = 'undocumented_changes' THEN 'warning' ELSE 'info' END AS severity,
 round(CASE drift WHEN 'synchronized' THEN 0 WHEN 'stable' THEN 0.1 WHEN 'spec_ahead_of_code' THEN 0.3 ELSE least(1::DOUBLE, drift_days / 365::DOUBLE) END::DOUBLE, 6) AS gap FROM k""",
}
