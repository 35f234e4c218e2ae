"""Grows the trees of ``pii.py`` on labelled text made by rule: ``python -m strataloom.llm.pii_train`` writes the model."""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pii import FEATURES, MODEL, WIDE, around, features, matches
from .quality import fit

ROWS = 4000


def _iban(r: random.Random, good: bool) -> str:
    country, body = r.choice(("DE", "FR", "ES", "GB")), "".join(r.choice("0123456789") for _ in range(r.choice((16, 18, 20))))
    digits = int(body + "".join(str(ord(c) - 55) for c in country) + "00")
    check = 98 - digits % 97
    if not good:
        check = (check + r.randrange(1, 96)) % 97
    flat = f"{country}{check:02d}{body}"
    return " ".join(flat[i : i + 4] for i in range(0, len(flat), 4)) if r.random() < 0.5 else flat


#: Wordings before a span, by what they speak for, in four languages; "" stands for none.
WORDINGS = {
    "local_phone": ("call ", "phone: ", "tel ", "mobile ", "fax ", "my cell is ", "Rufen Sie ", "Telefon: ", "meine Handynummer ist ", "appelez le ", "t\u00e9l. ", "mon num\u00e9ro est le ", "llame al ", "mi m\u00f3vil es ", "tel\u00e9fono: "),
    "ssn": ("ssn ", "social security number ", "SSN: ", "taxpayer id ", "Sozialversicherung ", "Steuernummer ", "Ausweis ", "s\u00e9curit\u00e9 sociale ", "num\u00e9ro fiscal ", "mi numero es ", "seguro social ", "DNI "),
    "iban": ("iban ", "account ", "transfer to ", "bank: ", "Konto ", "\u00fcberweisen an ", "virement sur ", "compte ", "cuenta ", "banco: ", ""),
    "none": ("order ", "part ", "version ", "serial #", "item:", "", "model ", "sku/", "ticket ", "build ", "invoice #", "Bestellung ", "Rechnung ", "Artikel ", "Teile ", "commande ", "facture ", "r\u00e9f\u00e9rence ", "pedido ", "factura ", "art\u00edculo ", "lote "),
}
WORDS = ("der ruf die nacht", "order of the day", "la partie est belle", "un banco verde", "call it a night", "numero uno", "tell them", "ein modell")  # hold parts of cues


def labelled_texts(seed: int = 5, rows: int = ROWS) -> list[tuple[str, str, int]]:
    """(kind, text with one proposed span, 1 if it is personal data); cues are left out or misleading in some of either sort."""
    r = random.Random(seed)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    filler = lambda: r.choice(WORDS) if r.random() < 0.1 else " ".join("".join(r.choice("aeionrst") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(0, 6)))
    out = []
    for _ in range(rows):
        kind, good = r.choice(WIDE), r.random() < 0.5
        if kind == "local_phone":
            sep = r.choice(" .-")
            area = r.randrange(200, 999) if good or r.random() < 0.6 else r.randrange(0, 200)
            span = f"{area:03d}{sep}{n(3)}{sep}{n(4)}"
        elif kind == "ssn":
            area = r.choice([a for a in range(1, 900) if a != 666]) if good or r.random() < 0.6 else r.choice((0, 666, 900 + r.randrange(100)))
            span = f"{area:03d}-{n(2)}-{n(4)}"
        else:
            span = _iban(r, good)
        cue = r.choice(WORDINGS[kind if good or (kind == "iban" and r.random() < 0.3) else "none"])
        tail = "" if good or r.random() < 0.8 else r.choice((" units", " kg", " pcs", " px", "%"))
        out.append((kind, f"{filler()} {cue}{span}{tail} {filler()}".strip(), int(good)))
    return out


def table_of_features(spark: SparkSession, texts: list[tuple[str, str, int]]) -> DataFrame:
    """kind, label and features of each text's first proposed span of its kind."""
    df = spark.createDataFrame(texts, "kind string, text string, label int")
    parts = []
    for k in WIDE:
        one = df.where(F.col("kind") == k).withColumn("s", F.element_at(matches(F.col("text"), k), 1)).where("s is not null")
        before, after = around(F.col("text"), F.col("s"))
        x = features(k, F.col("s")["hit"], before, after)
        parts.append(one.select("kind", "label", *[x[f].alias(f) for f in FEATURES]))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def train(spark: SparkSession, seed: int = 5) -> dict:
    """Trees from one half of the rows; for each kind the lowest threshold that lets through at most 1 in 100 others on the other half."""
    rows = table_of_features(spark, labelled_texts(seed)).toPandas()
    x, y = rows[list(FEATURES)].to_numpy(dtype=np.float64), rows["label"].to_numpy(dtype=np.float64)
    half = np.arange(len(rows)) % 2 == 0
    trees = fit(x[half], y[half], trees=20, depth=3, rate=0.3, least=15)
    p = trees.score(x)
    cut = {}
    for k in WIDE:
        own = ~half & (rows["kind"] == k).to_numpy()
        others = np.sort(p[own & (y == 0)])
        cut[k] = round(float(max(0.5, others[int(0.99 * len(others))] + 1e-6)), 6)
    listed = {n: [round(float(v), 6) if n in ("threshold", "value") else int(v) for v in getattr(trees, n)] for n in ("roots", "feature", "threshold", "left", "value")}
    return {"bias": round(trees.bias, 6), "cut": cut, **listed}


if __name__ == "__main__":
    MODEL.write_text(json.dumps(train(SparkSession.builder.getOrCreate())))
