"""Mixing of sources to tempered target weights, realised as block permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, fresh, full_text, looked_up, met, plainly
from .quality_rules import words_in


def tempered(totals: DataFrame, repetition_limit: float | None, target_entropy: float | None, rounds: int = 4, points: int = 255) -> float:
    """The exponent for token shares, by bisection over one row per source (``tokens``).

    The entropy of the weights, and the repetition of the smallest source against the
    largest, both fall as the exponent rises from 0 to 1. With ``target_entropy`` (a
    share of the entropy of equal weights) it is the largest exponent that reaches the
    target; with ``repetition_limit`` the result is at least the smallest exponent that
    keeps the limit. Every round evaluates ``points`` inner points in one aggregate, as
    eight halvings would, so nothing but sums comes to the driver.
    """
    some = totals.filter("tokens > 0")
    whole, least, most, n = some.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens"), F.count("*")).first()
    if not n or least == most:
        return 1.0

    def entropies(grid: list[float]) -> list[float]:
        share = F.col("tokens") / float(whole)
        row = some.agg(*(x for t in grid for x in (F.sum(F.pow(share, t)), F.sum(F.pow(share, t) * F.log(share))))).first()
        return [float(_ln(row[2 * i]) - t * row[2 * i + 1] / row[2 * i]) for i, t in enumerate(grid)]

    def largest(holds) -> float:
        """The largest exponent in [0, 1] for which ``holds`` (true below it), or 0."""
        low, high = 0.0, 1.0
        if holds([1.0])[0]:
            return 1.0
        for _ in range(rounds):
            grid = [low + (high - low) * (i + 1) / (points + 1) for i in range(points)]
            good = [t for t, ok in zip(grid, holds(grid)) if ok]
            low, high = (max(good) if good else low), min([t for t in grid if t not in set(good)], default=high)
        return low

    exponent = 0.0 if target_entropy is None else largest(lambda g: [h >= target_entropy * _ln(n) for h in entropies(g)])
    if repetition_limit is not None:
        ratio = float(most) / float(least)
        over = largest(lambda g: [ratio ** (1 - t) > repetition_limit for t in g])
        exponent = max(exponent, min(1.0, over + (points + 1.0) ** -rounds) if ratio > repetition_limit else 0.0)
    return exponent


def _ln(x: float) -> float:
    import math

    return math.log(x)


def unit(*columns: Column) -> Column:
    """A number in [0, 1) by hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def plan(docs: DataFrame, repetition_limit: float | None, target_entropy: float | None, seed: int, id_col: str, source_col: str, text_col: str, bucket_rows: int = 20_000) -> DataFrame:
    """Per source: tokens, weight, repetition, whole epochs, and the last place taken in the last epoch.

    A null source is the empty name; sources without tokens are used once; an empty table gives no rows.
    """
    meta = durable(docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(id_col).alias("id"), F.size(words_in(full_text(F.col(text_col)))).cast("long").alias("tokens")))
    totals = durable(meta.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    exponent = tempered(totals, repetition_limit, target_entropy)
    largest, widest, n_docs = totals.agg(F.max("tokens"), F.max("docs"), F.sum("docs")).first()
    largest, buckets = largest or 1, max(64, (widest or 0) // bucket_rows)
    share = F.when(F.col("tokens") > 0, F.col("tokens") / float(largest))
    rated = totals.withColumn("repetition", F.coalesce(F.pow(share, F.lit(exponent - 1.0)), F.lit(1.0))).withColumn("epochs", F.floor("repetition").cast("int"))
    rated = rated.withColumn("left", ((F.col("repetition") - F.col("epochs")) * F.col("tokens")).cast("double")).withColumn("exponent", F.lit(exponent))
    # The last epoch takes documents by place until the source's budget is spent. Places are
    # summed by bucket first, so no task holds more than a bucket of a source.
    placed = met(meta, durable(rated.filter("left > 0").select("source", "left", "epochs", F.col("docs").alias("n"))), ["source"], n_docs or 0).select("source", "left", "tokens", unit(F.col("id"), F.lit(seed), F.col("epochs")).alias("place"))
    placed = placed.withColumn("bucket", F.floor(F.col("place") * buckets).cast("int"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("sum"))
    sums = sums.withColumn("base", F.sum("sum").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("sum"))
    run = placed.join(sums.filter("base >= 0").hint("merge"), ["source", "bucket"]).filter(F.col("base") <= F.col("left"))
    run = run.withColumn("total", F.col("base") + F.sum("tokens").over(W.partitionBy("source", "bucket").orderBy("place").rangeBetween(W.unboundedPreceding, 0)))
    last = run.filter(F.col("total") <= F.col("left")).groupBy("source").agg(F.max("place").alias("last"))
    weight = F.col("repetition") * F.col("tokens")
    whole = rated.agg(F.sum(weight)).first()[0] or 1.0
    return durable(rated.join(last, "source", "left").select("source", "tokens", "docs", "exponent", "repetition", "epochs", F.coalesce("last", F.lit(-1.0)).alias("last"), (weight / float(whole)).alias("weight"), F.lit(float(whole)).alias("budget")))


def mix(
    docs: DataFrame,
    repetition_limit: float | None = 1.5,
    target_entropy: float | None = None,
    block_tokens: int = 1 << 20,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with a row for every use of a document, and columns ``_epoch``, ``_block``, ``_place``, ``_weight``.

    Weights are token shares to the power of the exponent that ``tempered`` finds,
    normalised. The budget is the least at which the largest source is used once, so no
    document is dropped: a source is repeated in whole epochs, and in a last one for the
    rest of its budget. Every epoch of a source is a permutation by hash, dealt evenly
    over blocks of about ``block_tokens`` tokens, so each block holds the sources in
    their weights; ``_place`` orders a block. Tokens are words. Texts are not shuffled.

    A null source is the one with the empty name; null and blank texts cost nothing and
    are used as often as their source; repeated rows are used each; documents of equal
    place (rows of one id) enter the last epoch together or not; an empty table gives
    no rows; columns of the input stay as they are, and an added column whose name the
    input has gets a longer one (``_epoch_``).
    """
    plain, names = plainly(docs)
    ident, source, text = names[id_col], names[source_col], names[text_col]
    by = plan(plain, repetition_limit, target_entropy, seed, ident, source, text).select("source", "repetition", "epochs", "last", "weight", "budget", F.col("docs").alias("n"))
    rows = looked_up(plain.withColumn("source", F.coalesce(F.col(source).cast("string"), F.lit(""))), by, ["source"])
    extra = F.when(unit(F.col(ident), F.lit(seed), F.col("epochs")) <= F.col("last"), 1).otherwise(0)
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1 + extra)))
    spot = F.least((F.col("epoch") + unit(F.col(ident), F.lit(seed), F.col("epoch"))) / F.col("repetition"), F.lit(1.0 - 1e-12))
    blocks = F.greatest(F.lit(1.0), F.ceil(F.col("budget") / block_tokens).cast("double"))
    rows = rows.withColumn("block", F.floor(spot * blocks).cast("long")).withColumn("place", F.xxhash64(F.col(ident), F.lit(seed), F.col("epoch"), F.lit(1)))
    return rows.select(*plain.columns, "epoch", "block", "place", "weight").toDF(*docs.columns, *fresh(docs.columns, "_epoch", "_block", "_place", "_weight"))


def mixed_in_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``mix``, dealt and sorted by block and place, with the columns of ``docs`` alone."""
    out = mix(docs, **options)
    width = len(docs.columns)
    rows = out.toDF(*(f"c{i}" for i in range(width)), "epoch", "block", "place", "weight")
    return rows.repartitionByRange("block", "place").sortWithinPartitions("block", "place").select(*rows.columns[:width]).toDF(*docs.columns)
