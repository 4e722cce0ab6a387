"""Bounded labelled samples for fitting small models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import full_text, remainder


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> pd.DataFrame:
    """At most ``per_class`` rows of each label 0 and 1 with their texts, chosen by hash of the id.

    Rows whose crc32(id) mod ``modulus`` is ``held_out`` are never taken, nor null
    ids or labels. An id labelled more than once takes its largest label. Only the
    chosen ids are joined with the texts, so what reaches the driver is bounded.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (remainder(F.col(id_col), modulus) != held_out))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"), F.count("*").alias("n"))
    drawn = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    chosen = drawn[0].unionByName(drawn[1]).select("id", "y")
    texts = docs.select(F.col(id_col).alias("id"), full_text(F.col(text_col)).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id")  # at most 2 * per_class rows
    return rows.toPandas().drop_duplicates("id").sort_values("id").reset_index(drop=True)
