import random

import pyspark.sql.types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(spark, rows):
    """rows: (doc_id, text, lang, source); more columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("size", "target", "score", "rank", "blob", "spans", "ids", "class_id", "component", "node", "rep", "band", "_id", "_blob", "_spans", "_n", "_size", "_taken", "label") if c not in df.columns})


def prose(rng: random.Random, n: int, vocabulary: int = 3000) -> list[str]:
    return [f"w{rng.randint(0, vocabulary)}" for _ in range(n)]
