"""Policy checks, entity counts and redaction by pattern, all in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of secrets, of attempts to override instructions, of instructions that are blocked, and of those that are only set aside (any case).
SECRET = {
    "private_key": r"-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----",
    "pem": r"-----BEGIN\s+PEM-----",
    "certificate": r"-----BEGIN\s+CERTIFICATE-----",
    "api_key": r"(?:api[_-]?key|apikey)\s*[:=]\s*\S{8,}",
    "password": r"(?:secret|token|password|passwd|pwd)\s*[:=]\s*\S{8,}",
    "cloud_key": r"(?:aws_access_key_id|aws_secret_access_key)\s*[:=]\s*\S+",
    "forge_token": r"ghp_[A-Za-z0-9]{36,}",
    "model_key": r"sk-[A-Za-z0-9]{20,}",
    "web_token": r"eyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}",
    "long_base64": r"[A-Za-z0-9+/]{60,}={1,2}",
}
INJECTION = {
    "ignore": r"ignore\s+(?:all\s+)?previous\s+instructions?",
    "forget": r"forget\s+(?:all\s+)?(?:your\s+)?(?:previous\s+)?instructions?",
    "you_are_now": r"you\s+are\s+now\s+(?:a|an)\s+",
    "store_as_system": r"store\s+this\s+(?:as\s+)?(?:a\s+)?system\s+prompt",
    "override": r"override\s+(?:system|safety|security)",
    "system_tag": r"<\s*system\s*>",
    "system_mark": r"\[\s*SYSTEM\s*\]",
    "pretend": r"pretend\s+(?:to\s+be|you\s+are)",
}
BLOCK = {
    "persona": r"you\s+are\s+(?:Chat\s*GPT|Claude|GPT|Gemini|an?\s+AI)",
    "role": r"(?:^|\n)(?:System|Developer|Assistant|Human)\s*:",
    "memory_call": r"(?:use|call|invoke|run)\s+memory_\w+",
    "tool_call": r"(?:use|call|invoke|run)\s+(?:the\s+)?(?:tool|function)\s+",
    "call_object": r"\{\s*\"(?:tool_name|action|function_call|tool_use)\"\s*:",
    "arguments": r"\{\s*\"(?:parameters|arguments|params)\"\s*:\s*\{",
    "open_tag": r"<\s*(?:tool_use|tool_result|result|function_call)\s*>",
    "any_tag": r"<\s*/?\s*(?:tool_use|tool_result|result|function_call)\s*>",
}
QUARANTINE = {
    "remember": r"(?:always|never)\s+(?:remember|forget)\s+(?:to\s+)?",
    "later": r"in\s+(?:future|subsequent|later)\s+(?:sessions?|conversations?|turns?)",
    "must": r"(?:you\s+)?(?:must|should|shall)\s+(?:always|never)\s+",
    "from_now_on": r"(?:from\s+now\s+on|henceforth|going\s+forward)\s*[,.]?\s+",
}
RULES = {"secret": SECRET, "injection": INJECTION, "instruction": BLOCK, "quarantine": QUARANTINE}
#: Entity patterns.
ENTITY = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b",
    "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "cve": r"\bCVE-[0-9]{4}-[0-9]{4,}\b",
}
#: What each secrecy tier redacts, in this order, and by what mark.
REDACT = {
    "paths": (r"(?:/[\w.-]+){2,}|[A-Z]:\\[\w\\.-]+", "[PATH]"),
    "emails": (r"[\w.+-]+@[\w.-]+\.\w{2,}", "[EMAIL]"),
    "hostnames": (r"(?i)\b[\w-]+\.(?:corp|internal|local|intra|lan|company|enterprise|office|srv|server)\b", "[HOST]"),
    "ips": (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[IP]"),
    "filenames": (r"(?i)\b[\w.-]+\.(?:pdf|docx?|xlsx?|pptx?|csv|txt|log|cfg|conf|yaml|yml|xml)\b", "[FILE]"),
    "pointer_ids": (r"(?i)\bMEM-[0-9a-f]{8,}\b", "[MEM-ID]"),
    "hashes": (r"\bsha256:[0-9a-f]{16,}\b", "[HASH]"),
    "entity_labels": (r"(?i)\b[\w-]+\.(?:corp|internal|local|intra|lan)\b|\b(?:srv|db|app|web|api|mgmt|admin)-\d{1,3}\b", "[ENTITY]"),
}
TIERS = {
    "S0": ("paths", "emails", "hostnames", "ips", "filenames", "pointer_ids", "hashes", "entity_labels"),
    "S2": ("hostnames", "ips", "hashes"),
    "S3": (),
}


def policy(docs: DataFrame, most_chars: int = 8000, text: str = "text") -> DataFrame:
    """(doc_id, action, reasons): rejected for secrets, overriding or blocked instructions or length; set aside for instructions to itself; else accepted."""
    t = F.coalesce(text, F.lit(""))
    found = [F.when(F.rlike(t, F.lit(f"(?i){p}")), F.lit(f"{group}:{name}")) for group, many in RULES.items() for name, p in many.items()]
    found.append(F.when(F.length(t) > most_chars, F.lit("too_long")))
    rows = docs.select("doc_id", F.array_compact(F.array(*found)).alias("r"))
    hard = F.exists("r", lambda x: ~F.startswith(x, F.lit("quarantine:")))
    return rows.select("doc_id", F.when(hard, "reject").when(F.size("r") > 0, "quarantine").otherwise("accept").alias("action"), F.array_join("r", ",").alias("reasons"))


def entity_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_...) of each entity pattern."""
    t = F.coalesce(text, F.lit(""))
    return docs.select("doc_id", *[F.regexp_count(t, F.lit(p)).cast("long").alias(f"n_{k}") for k, p in ENTITY.items()])


def redact(text: Column, tier: str) -> Column:
    """The text with what its tier hides replaced, rule after rule."""
    return reduce(lambda c, k: F.regexp_replace(c, REDACT[k][0], REDACT[k][1].replace("$", r"\$")), TIERS[tier], F.coalesce(text, F.lit("")))


def redacted(docs: DataFrame, tier: str, text: str = "text") -> DataFrame:
    """(doc_id, text, changes): redacted texts and how many replacements each rule's mark shows."""
    out = docs.select("doc_id", redact(F.col(text), tier).alias("text"))
    marks = [F.regexp_count("text", F.lit(REDACT[k][1].replace("[", r"\[").replace("]", r"\]"))) for k in TIERS[tier]]
    return out.withColumn("changes", reduce(Column.__add__, marks, F.lit(0)).cast("long"))
