from __future__ import annotations

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0, sources=("a", "b", None)):
    rows = [(first + i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(df):
    """The same rows with columns that operators might use themselves."""
    for name in ("id", "spans", "node", "_node", "_id", "n", "key", "block", "unit", "role", "size", "taken", "_row", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    return df


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", " \n\t ", "one", "Ünï ſK token = x", "a" * 100_000, "x " * 50_000, "#" * 300, "\x00\x1c\x85 b", "﷐ ﷑"]
