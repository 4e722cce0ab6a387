"""Near-duplicates by SimHash: fingerprints, deletion-variant index, verified links, groups."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, durable, forget, full_text, met, plainly

BITS = 64


def fingerprints_of(texts: list[str | None], words: int = 3) -> np.ndarray:
    """64-bit SimHash of each text over its word shingles, repeats included (signed view)."""
    import xxhash

    out = np.zeros(len(texts), dtype=np.uint64)
    hashes, counts = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        w = (text or "").encode().lower().split()
        if not w:
            continue
        shingles = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype=np.uint64)
        hashes.append(h)
        counts[i] = len(h)
    some = np.flatnonzero(counts)
    if len(some):
        flat = np.concatenate(hashes)
        first = np.cumsum(counts[some]) - counts[some]
        bits = np.unpackbits(flat.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        major = (2 * ones > counts[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out.view(np.int64)


def with_fingerprints(docs: DataFrame, text_col: str = "text", words: int = 3) -> DataFrame:
    """``docs`` with a last column ``_fp``; other columns pass unchanged, without a shuffle."""
    at = docs.columns.index(text_col)
    renamed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))

    def run(batches):
        for b in byte_slices(batches, f"c{at}", 4 << 20):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fingerprints_of(b.column(at).to_pylist(), words), pa.int64())], names=[*b.schema.names, "f"])

    return renamed.mapInArrow(run, f"{kinds}, f long").toDF(*docs.columns, "_fp")


def variants(fp: Column) -> Column:
    """The one-wildcard variants of both 32-bit segments: 64 keys.

    Two fingerprints that differ in at most two bits differ in at most one bit of one
    segment, and then share the variant in which that bit (or any, if none differs) is
    taken out. A key holds the segment without the bit, and which bit of which segment.
    """
    keys = []
    for half in (0, 1):
        segment = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        keys += [segment.bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << bit))).bitwiseOR(F.lit((32 * half + bit) << 32)) for bit in range(32)]
    return F.array(*keys)


def near(fp: Column) -> Column:
    """The fingerprint itself and the 64 that differ from it in one bit."""
    signed = [1 << b if b < 63 else -(1 << 63) for b in range(BITS)]
    return F.array(fp, *(fp.bitwiseXOR(F.lit(s).cast("long")) for s in signed))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, that join exactly the fingerprints within two bits of each other.

    ``fps`` has one row per distinct ``fp``. A variant held by two fingerprints is a
    candidate pair, verified by its differing bits. Members of a variant held by more
    meet its least member, verified alike; their other pairs are not expanded but found
    through a second exact index: two fingerprints within two bits always meet at a
    common neighbour one bit from both, and all that meet there are within two bits;
    each is linked to the least of them. Rows grow in proportion to fingerprints,
    however large a group is, and no variant's members gather in one task.
    """
    fps = durable(fps)
    count = fps.count()
    n = count * BITS
    fps = fps.repartition(max(fps.sparkSession.sparkContext.defaultParallelism, count // 50_000), "fp")  # each row becomes 64
    indexed = fps.select("fp", F.explode(variants(F.col("fp"))).alias("key"))
    held = durable(indexed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("b"), F.max("fp").alias("a")).filter("n > 1"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = held.filter("n = 2").select("a", "b")
    crowd = durable(met(indexed, held.filter("n > 2").select("key", "n", "b"), ["key"], n).select(F.col("fp").alias("a"), "b").distinct())
    meeting = crowd.select("a").distinct().select("a", F.explode(near(F.col("a"))).alias("z"))
    least = durable(meeting.groupBy("z").agg(F.min("a").alias("b"), F.count("*").alias("n")).filter("n > 1"))
    stars = met(meeting, least, ["z"], n).filter("a > b").select("a", "b")
    return pairs.unionByName(crowd.filter("a > b")).filter(close).unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges with the least node reachable from it.

    Alternating large-star and small-star steps, each written to the shared folder,
    until nothing changes; a logarithmic number of rounds. Least neighbours are found
    by partial sums, and nodes of many edges do not gather them in a task (``met``).
    Nothing is collected but two sums per round.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near_ = durable(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        large = durable(met(both.filter("v > u"), near_, ["u"], 2 * state[0]).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u > v").distinct())
        below = durable(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = met(large, below, ["u"], 2 * state[0])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u > v")
        old, edges = edges, durable(small.distinct())
        forget(old, near_, large, below)
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def groups(docs: DataFrame) -> DataFrame:
    """(fp, root) of the fingerprints that link to others, from a frame with ``_fp``."""
    return components(links(docs.select(F.col("_fp").alias("fp")).distinct()))


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    Fingerprints link at two or fewer differing bits; component_id is the least id of
    the linked documents, itself included. Null, empty and blank texts have
    fingerprint zero and link like any other; shorter texts than a shingle hash as a
    whole; equal texts share a fingerprint, which is indexed once. Repeated rows get a
    row each; a null id never names a component unless all its ids are null; an empty
    table gives no rows; further columns are not read.
    """
    marked = durable(with_fingerprints(docs.select(F.col(id_col).alias("id"), full_text(F.col(text_col)).alias("text")), "text", words).drop("text"))
    per_fp = marked.groupBy("_fp").agg(F.min("id").alias("least"))  # partial sums first: a hot fingerprint costs a row a task
    rooted = per_fp.join(groups(marked), F.col("_fp") == F.col("node"), "left").select("_fp", F.coalesce("root", "_fp").alias("root"), "least")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = durable(rooted.select("_fp", "root").join(named, "root").select("_fp", "component_id"))
    out = marked.join(by_fp, "_fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked fingerprints: that of the least id, nulls last.

    Groups are those of ``near_duplicates``; of repeated rows one is kept; columns of any names pass.
    """
    plain, names = plainly(docs)
    marked = durable(with_fingerprints(plain, names[text_col], words).withColumn("row", F.monotonically_increasing_id()))
    least = F.min(F.struct(F.col(names[id_col]).isNull().alias("none"), F.col(names[id_col]).alias("id"), F.col("row"))).alias("least")
    per_fp = marked.groupBy("_fp").agg(least)
    rooted = per_fp.join(groups(marked), F.col("_fp") == F.col("node"), "left").select(F.coalesce("root", "_fp").alias("root"), "least")
    chosen = durable(rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("row")))
    return marked.join(chosen.hint("merge"), "row", "left_semi").select(*plain.columns).toDF(*docs.columns)
