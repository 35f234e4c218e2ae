"""Scorecards: structure, intent, density of actions and readiness of documents; flows and modules by volume; drift of code and documents."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.documents import linguistic_quality

#: Words that show what a text is for.
INTENT = {
    "prescriptive": (r"must|shall|should|required|mandatory", r"follow|implement|ensure|comply|adhere", r"doit|devra|devrait|obligatoire|nécessaire"),
    "decisional": (r"decision|decided|approve[ds]?|reject[eds]?|agreed?", r"vote[ds]?|resolution|consensus|ratifi[edy]", r"décision|décidé|approuvé|rejeté|accord"),
    "descriptive": (r"describes?|explains?|defines?|presents?|represents?", r"consists? of|contains?|includes?|comprises?", r"décrit|explique|définit|présente|comprend"),
    "exploratory": (r"might|could|possibly|potentially|consider", r"alternative|option|hypothesis|maybe|perhaps", r"pourrait|possible|potentiel|alternative|hypothèse"),
}
#: Words for actions.
ACTIONS = r"permet|définit|décrit|gère|assure|contrôle|surveille|affiche|creates|defines|manages|controls|displays|exports|validates"
#: Scores from which a document is ready for minutes or summaries, or ready with help.
READY = {"mri": (0.75, 0.45), "sri": (0.70, 0.50)}


def _words(pattern: str) -> str:
    return rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{pattern})(?![\p{{L}}\p{{N}}_])"


def _forms(pattern: str) -> set[str]:
    """All texts that a pattern of alternatives with classes and optional letters stands for."""
    out = set()
    for one in pattern.split("|"):
        forms = {""}
        for some, maybe, letter, at_most in re.findall(r"\[([^\]]*)\](\??)|(.)(\??)", one):
            forms = {f + c for f in forms for c in [*(some or letter), *([""] if maybe or at_most else [])]}
        out |= forms
    return out


def _among(words: set[str]):
    return lambda w: w.isin(sorted(words))


def _word_counts(patterns: dict[str, list[str]], text: str, low: str, hits: str) -> list[Column]:
    """How often each list of patterns occurs as whole words, whatever the case; ``hits`` are the text's words that are in some pattern.

    A form of several words is looked for in the text itself, if its first word is there at all.
    """
    out = []
    for name, many in patterns.items():
        total = F.lit(0)
        for p in many:
            forms = _forms(p)
            total = total + F.size(F.filter(hits, _among({x for x in forms if " " not in x})))
            for one in [x for x in p.split("|") if " " in x]:
                start = os.path.commonprefix(sorted(_forms(one)))
                total = total + F.when(F.contains(low, F.lit(start)), F.regexp_count(text, F.lit(_words(one)))).otherwise(0)
        out.append(total.alias(name))
    return out


def structure_score(text: Column) -> Column:
    """Paragraphs of 100 to 500 characters, headings of three levels, and the share of list lines."""
    t = F.coalesce(text, F.lit(""))
    paragraphs = F.filter(F.transform(F.split(t, r"\n\s*\n"), lambda p: F.length(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda n: n > 20)
    fit = F.size(F.filter(paragraphs, lambda n: n.between(100, 500))) / F.size(paragraphs)
    para = F.when(F.size(paragraphs) > 1, fit).otherwise(0.5)
    h1, h2, h3 = (F.rlike(t, F.lit(rf"(?m)^{'#' * k}\s+")) for k in (1, 2, 3))
    add = lambda c, v: F.when(c, v).otherwise(0.0)
    heads = add(h1, 0.3) + add(h2, 0.3) + add(h1 & h2, 0.2) + add(h2 & h3, 0.2)
    items = F.regexp_count(t, F.lit(r"(?m)^[ \t]*[-*•][ \t]+")) + F.regexp_count(t, F.lit(r"(?m)^[ \t]*[0-9]+[.)][ \t]+"))
    ratio = items / F.size(F.split(t, "\n"))
    lists = F.when(ratio.between(0.1, 0.4), 1.0).when(ratio < 0.1, 0.7).otherwise(F.greatest(F.lit(0.0), 1 - (ratio - 0.4) * 2))
    return F.when(t == "", 0.0).otherwise(0.25 * para + 0.35 * heads + 0.4 * lists)


def scorecard(docs: DataFrame, coherence: float = 0.5, text: str = "text") -> DataFrame:
    """(doc_id, lq, sq, ir, entropy, actions, mri, sri, qa, tags): scores from 0 to 1 and what they allow; coherence is taken as neutral."""
    t, patterns = F.coalesce(text, F.lit("")), {**INTENT, "acts": [ACTIONS]}
    # Words are cut once, and only those that are in some pattern are counted; the four letters are those that fold to ASCII ones.
    looked_for = sorted({f for many in patterns.values() for p in many for f in _forms(p) if " " not in f})
    rows = docs.select("doc_id", t.alias("text")).withColumn("low", F.lower(F.translate("text", "\u017f\u212a\u0131\u0130", "skii")))
    rows = rows.withColumn("hits", F.filter(F.split("low", r"[^\p{L}\p{N}_]+"), lambda w: w.isin(looked_for)))
    rows = rows.select("doc_id", structure_score(F.col("text")).alias("sq"), F.regexp_count("text", F.lit(r"\S+")).alias("n_words"), *_word_counts(patterns, "text", "low", "hits"))
    rows = rows.withColumn("actions", F.when(F.col("n_words") > 0, F.least(F.lit(1.0), F.col("acts") / F.col("n_words") * 100 / 5)).otherwise(0.0))
    total = reduce(Column.__add__, [F.col(k) for k in INTENT])
    share = [F.col(k) / total for k in INTENT]
    entropy = reduce(Column.__add__, [F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in share]) / 2.0
    rows = rows.withColumn("entropy", F.when(total > 0, entropy).otherwise(1.0)).withColumn("top", F.when(total > 0, F.greatest(*share)).otherwise(0.0)).withColumn("any", total > 0)
    clear = F.when(F.col("top") >= 0.8, F.least(F.lit(1.0), 1.1 - F.col("entropy"))).otherwise(1.0 - F.col("entropy"))
    rows = rows.withColumn("ir", F.when(F.col("any"), clear).otherwise(0.5))
    rows = rows.join(linguistic_quality(docs).select("doc_id", F.col("quality").alias("lq")), "doc_id")
    mri = 0.35 * F.col("lq") + 0.25 * F.col("sq") + 0.25 * (1 - F.col("entropy")) + 0.15 * F.col("actions")
    sri = 0.30 * F.col("lq") + 0.30 * F.col("sq") + 0.20 * coherence + 0.20 * F.col("ir")
    qa = 0.25 * F.col("lq") + 0.20 * F.col("sq") + 0.35 * coherence + 0.20 * F.col("ir")
    rows = rows.select("doc_id", *[F.round(c, 6).alias(n) for n, c in (("lq", F.col("lq")), ("sq", F.col("sq")), ("ir", F.col("ir")), ("entropy", F.col("entropy")), ("actions", F.col("actions")), ("mri", mri), ("sri", sri), ("qa", qa))])
    two = lambda c, hi, a, lo, b: F.when(F.col(c) >= hi, a).when(F.col(c) < lo, b)
    tags = F.array_compact(F.array(
        two("sq", 0.7, "well_structured", 0.4, "needs_structure"), two("lq", 0.7, "high_linguistic_quality", 0.4, "low_linguistic_quality"),
        F.when(F.col("entropy") < 0.3, "clear_intent").when(F.col("entropy") >= 0.5, "mixed_intent"),
        two("mri", READY["mri"][0], "minutes_ready", READY["mri"][1], "minutes_needs_rewrite"), two("sri", READY["sri"][0], "summary_ready", READY["sri"][1], "summary_unsuitable"),
    ))
    return rows.withColumn("tags", tags)


def scorecard_summary(cards: DataFrame) -> DataFrame:
    """One row: documents, mean scores, how many are ready, need attention, and fall into each class."""
    mri, sri = F.col("mri"), F.col("sri")
    return cards.agg(
        F.count("*").alias("documents"), F.avg("lq").alias("lq"), F.avg("sq").alias("sq"), F.avg("ir").alias("ir"), F.avg("mri").alias("mri"), F.avg("sri").alias("sri"),
        F.count_if(mri >= READY["mri"][0]).alias("minutes_ready"), F.count_if(sri >= READY["sri"][0]).alias("summary_ready"), F.count_if((mri < READY["mri"][1]) & (sri < READY["sri"][1])).alias("attention"),
        F.count_if(mri >= 0.75).alias("excellent"), F.count_if((mri >= 0.6) & (mri < 0.75)).alias("good"), F.count_if((mri >= 0.45) & (mri < 0.6)).alias("acceptable"), F.count_if(mri < 0.45).alias("poor"),
    )


def flows(volumes: DataFrame, largest: float) -> DataFrame:
    """(name, volume_day, first, last, multiplier) with the mean, windowed and peak rates a second, and the volume from 0 to 10 of the largest."""
    hours = F.pmod(F.col("last") - F.col("first"), F.lit(24))
    mean = F.col("volume_day") / 86_400
    window = F.when(hours > 0, F.col("volume_day") / (hours * 3600)).otherwise(mean)
    return volumes.withColumns({"mean_rate": F.round(mean, 6), "window_rate": F.round(window, 6), "peak_rate": F.round(window * F.col("multiplier"), 6), "score": F.round(F.least(F.lit(10.0), F.col("volume_day") / largest * 10), 6)})


def modules(members: DataFrame, of_flows: DataFrame) -> DataFrame:
    """(module, role, flows, volume_day, peak_rate, criticality) of modules (module, role, flow)."""
    out = members.join(of_flows.select(F.col("name").alias("flow"), "volume_day", "peak_rate"), "flow").groupBy("module", "role").agg(F.count("*").alias("flows"), F.sum("volume_day").alias("volume_day"), F.max("peak_rate").alias("peak_rate"))
    v, p = F.col("volume_day"), F.col("peak_rate")
    grade = F.when(F.col("role").isin("entry_point", "gateway") | (p > 500), "CRITICAL").when((v > 1_000_000) | (p > 100), "HIGH").when((v > 100_000) | (p > 50), "MEDIUM").otherwise("LOW")
    return out.withColumn("criticality", grade)


def drift_classes(both: DataFrame, threshold: int = 180) -> DataFrame:
    """(component, days_code, days_doc) with drift_days, drift, severity and gap; days_doc is null without documents."""
    code, doc = F.col("days_code") < threshold, F.col("days_doc") < threshold
    gap_days = F.coalesce(F.greatest(F.col("days_doc") - F.col("days_code"), F.lit(0)), F.lit(0))
    kind = F.when(F.col("days_doc").isNull(), "undocumented_changes").when(code & doc & (gap_days < 30), "synchronized").when(code, "undocumented_changes").when(doc, "spec_ahead_of_code").otherwise("stable")
    out = both.withColumn("drift_days", gap_days).withColumn("drift", kind)
    severity = F.when(F.col("days_doc").isNull(), "warning").when(code & ~doc & (F.col("drift_days") > 180), "error").when(F.col("drift") == "undocumented_changes", "warning").otherwise("info")
    gap = F.when(F.col("drift") == "synchronized", 0.0).when(F.col("drift") == "stable", 0.1).when(F.col("drift") == "spec_ahead_of_code", 0.3).otherwise(F.least(F.lit(1.0), F.col("drift_days") / 365))
    return out.withColumn("severity", severity).withColumn("gap", gap)
