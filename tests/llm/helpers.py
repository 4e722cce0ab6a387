"""Awkward rows that every text operator must take."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators also produce
        T.StructField("score", T.StringType()),
        T.StructField("n_tokens", T.StringType()),
        T.StructField("block", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
    ]
)
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
TEXTS = [None, "", " \n\t ", "one", "a  b\n\n c  d  e", "x" * 3000, "<|endoftext|> it's 'll\r\nÀÉ ßς ΑΣ 123 ###", LONG, "same same", "same same", "tail \x1c y\u0085 z\x0b!"]


def awkward(spark):
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None if t is None else len(t), "q", "q", "q", "q", "q") for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[9], (None, "one", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
