"""Memory of op3's tasks: blocks reach a worker one by one, however many a task reads."""

from pyspark.sql import functions as F

from rasterloom.llm import hmm


def test_language_model_sends_one_block_a_batch(spark, monkeypatch):
    key, sizes, plain = "spark.sql.execution.arrow.maxBytesPerBatch", [], hmm.gathered_counts

    def counted(blocks, shared):
        import pyarrow as pa

        def rows(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["rows"])

        sizes.extend(r.rows for r in blocks.coalesce(1).select("held_out", "lengths", "words", "codes").mapInArrow(rows, "rows long").collect())
        return plain(blocks, shared)

    monkeypatch.setattr(hmm, "gathered_counts", counted)
    before = spark.conf.get(key)
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1_100_000)), lambda x: F.concat(F.lit("w"), (x * (F.col("id") + 7) % 997).cast("string"))), " ")
    docs = spark.range(1, 5, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))  # texts of more than a block
    got = hmm.score(docs, states=2, frequent=16, shared_classes=4, rounds=1)
    assert sizes == [1, 1, 1, 1]
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()  # nothing runs later in other batches
    assert [r.n_tokens for r in got.collect()] == [1_100_002] * 4 and spark.conf.get(key) == before


def test_language_model_keeps_one_block_a_row_group(spark, monkeypatch):
    import pyarrow.parquet as pq

    groups, plain = [], hmm.gathered_counts

    def counted(blocks, shared):
        for name in blocks.inputFiles():
            meta = pq.ParquetFile(name.removeprefix("file://")).metadata
            groups.extend(meta.row_group(i).num_rows for i in range(meta.num_row_groups))
        return plain(blocks, shared)

    monkeypatch.setattr(hmm, "gathered_counts", counted)
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1_100_000)), lambda x: F.concat(F.lit("w"), (x * (F.col("id") + 7) % 997).cast("string"))), " ")
    docs = spark.range(1, 5, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))  # texts of more than a block, in one task
    got = hmm.score(docs, states=2, frequent=16, shared_classes=4, rounds=1)
    assert groups == [1, 1, 1, 1]
    assert [r.n_tokens for r in got.collect()] == [1_100_002] * 4
