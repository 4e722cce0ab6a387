"""Near-dedup of whole texts at a shingle similarity: SimHash segments propose pairs, true Jaccard decides.

One 64-bit SimHash with equal votes cannot serve a Jaccard similarity of 0.8: its bits
then differ with probability 0.15, about ten of 64. So the fingerprint here is wide, and
its parts weight the votes: in every part of 16 bits a shingle votes with the weight
u ** -POWER, where u in (0, 1) is drawn by hash for the shingle and the part. A few shingles
decide a part, and texts that share them agree in all its bits or in all but one.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, durable, forget, full_text, met, plainly, ragged_take, starts
from .simhash import components

#: A segment of PARTS x 16 bits of two texts of similarity 0.8 agrees but for one bit among the
#: LOOSE least certain with probability 0.28 (simulated), so none of SEGMENTS does with 0.005.
SEGMENTS, PARTS, LOOSE, POWER = 16, 3, 2, 1.5
#: Votes beyond about this many heaviest shingles of a text weigh too little to count.
VOTERS = 48
KEYS = SEGMENTS * (LOOSE + 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20)
_FLIP = _RNG.integers(0, 1 << 63, SEGMENTS * PARTS, dtype=np.uint64)
_TURN = _RNG.integers(0, 1 << 63, SEGMENTS * PARTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(31))) * _MIX
    return v ^ (v >> np.uint64(29))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Hashes of the word shingles in order, repeats included; a shorter text is one shingle."""
    import xxhash

    w = (text or "").encode().lower().split()
    parts = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), dtype=np.uint64)


def signatures(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: a 64-bit name of its set of shingles, the size of the set, and its variants (KEYS numbers).

    A segment gives LOOSE + 1 variants: itself, and itself with a wildcard in place of
    each of its bits whose vote was closest, where a change of the text turns a bit first.
    """
    sets = [np.unique(shingles(t, words)) for t in texts]
    flat, size = np.concatenate(sets), np.array([len(s) for s in sets])
    first = np.cumsum(size) - size
    least = np.where(size <= VOTERS, 1.0, VOTERS / size)
    limit = np.repeat((least * (2.0**64 - 2048)).astype(np.uint64), size)
    of = np.repeat(np.arange(len(texts)), size)
    name = _mixed(np.add.reduceat(_mixed(flat), first) + size.astype(np.uint64))
    segment = np.zeros((len(texts), SEGMENTS), dtype=np.uint64)
    margin = np.empty((len(texts), SEGMENTS, PARTS * 16), dtype=np.float32)
    for part in range(SEGMENTS * PARTS):
        drawn = flat * _TURN[part]  # hashes are spread already, so an odd factor orders them anew
        heavy = np.flatnonzero(drawn <= limit)
        voters = np.bincount(of[heavy], minlength=len(texts))
        if not voters.all():  # once in e ** VOTERS
            heavy = np.flatnonzero((drawn <= limit) | (voters == 0)[of])
            voters = np.bincount(of[heavy], minlength=len(texts))
        drawn, mine = drawn[heavy], of[heavy]
        weight = (((drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 1e-12) / least[mine]) ** -POWER
        bits = np.unpackbits(_mixed(drawn ^ _FLIP[part]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :2], axis=1, bitorder="little")
        at = np.cumsum(voters) - voters
        votes = np.add.reduceat((bits * 2.0 - 1.0) * weight[:, None], at, axis=0)
        which, place = divmod(part, PARTS)
        margin[:, which, place * 16 : place * 16 + 16] = np.abs(votes) / np.add.reduceat(weight, at)[:, None]
        value = np.packbits(votes > 0, axis=1, bitorder="little").view("<u2").ravel().astype(np.uint64)
        segment[:, which] |= value << np.uint64(16 * place)
    loose = np.argpartition(margin, LOOSE, axis=2)[:, :, :LOOSE].astype(np.uint64)
    keys = np.empty((len(texts), SEGMENTS, LOOSE + 1), dtype=np.uint64)
    mark = np.arange(SEGMENTS, dtype=np.uint64)[None, :] << np.uint64(56)
    keys[:, :, 0] = _mixed(segment | mark)
    for i in range(LOOSE):
        bit = loose[:, :, i]
        keys[:, :, i + 1] = _mixed(segment & ~(np.uint64(1) << bit) | mark | (bit + np.uint64(1)) << np.uint64(48))
    return name.view(np.int64), size, keys.reshape(len(texts), KEYS).view(np.int64)


def marked_texts(docs: DataFrame, text_at: int, words: int) -> DataFrame:
    """``docs`` (columns c0, c1, ...) with ``row``, ``node`` (name of the set of shingles), ``size`` and ``keys``; no shuffle."""
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 36
        for b in byte_slices(batches, f"c{text_at}", 2 << 20):
            name, size, keys = signatures(b.column(text_at).cast(pa.string()).to_pylist(), words)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, KEYS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(at, at + len(b))), pa.array(name), pa.array(size, pa.int64()), listed], names=[*b.schema.names, "row", "node", "size", "keys"])
            at += len(b)

    return docs.mapInArrow(run, f"{kinds}, row long, node long, size long, keys array<long>")


def similar(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have a Jaccard similarity of ``percent`` or more.

    ``pairs`` carries the sizes of the sets, which alone rule out many; ``texts`` has columns node and t.
    """
    fits = F.least("sa", "sb") * 100 >= F.greatest("sa", "sb") * percent
    pairs = durable(pairs.filter("a <> b").filter(fits).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    found = durable(texts.join(wanted.hint("merge"), "node", "left_semi").dropDuplicates(["node"]))

    def run(batches):
        for batch in batches:
            for b in byte_slices([batch], "tb", 2 << 20):
                known, yes = {}, []

                def of(node, text):
                    if node not in known:
                        known[node] = np.unique(shingles(text, words))
                    return known[node]

                for a, o, x, y in zip(*(b.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))):
                    p, q = of(a, x), of(o, y)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    yes.append(100 * both >= percent * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(yes, pa.bool_()))

    both = pairs.join(found.select(F.col("node").alias("a"), F.col("t").alias("ta")).hint("merge"), "a").join(found.select(F.col("node").alias("b"), F.col("t").alias("tb")).hint("merge"), "b")
    out = durable(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))
    forget(pairs, found)
    return out


def crossing(rows: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of every two groups that meet in a variant, one similar pair (a, b) if there is any there; all pairs across groups are compared.

    ``rows`` (key, a, root, tiles) are the sets of variants and their groups. A variant's sets
    are dealt to its ``tiles``, and any two tiles meet in a task, which counts the common shingles
    of all pairs across groups from lists of holders; no row is made for a pair that is not similar.
    """
    wanted = rows.select(F.col("a").alias("node")).distinct()
    found = texts.join(wanted.hint("merge"), "node", "left_semi").dropDuplicates(["node"])

    def listed(batches):
        for batch in batches:
            for b in byte_slices([batch], "t", 2 << 20):
                sets = [np.unique(shingles(t, words)) for t in b.column("t").to_pylist()]
                offsets = pa.array(starts(np.array([len(s) for s in sets])), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))], names=["a", "held"])

    def compare(rows):
        a, root, held = (rows[c].combine_chunks() for c in ("a", "root", "held"))
        a, group = a.to_numpy(), np.unique(root.to_numpy(), return_inverse=True)[1]
        p, q = similar_across(held.flatten().to_numpy(), pc.list_value_length(held).to_numpy().astype(np.int64), group, percent)
        return pa.table({"a": a[p], "b": a[q]})

    held = durable(found.select("node", "t").mapInArrow(listed, "a long, held array<long>"))
    tile = F.pmod(F.xxhash64("a"), F.col("tiles")).cast("int")
    met_in = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.struct(F.least(u, tile).alias("i"), F.greatest(u, tile).alias("j")))
    dealt = rows.select("key", "a", "root", F.explode(met_in).alias("at")).select("key", "a", "root", "at.i", "at.j")
    out = durable(dealt.join(held.hint("merge"), "a").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct())
    forget(held)
    return out


def similar_across(flat: np.ndarray, size: np.ndarray, group: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (p, q) of one pair of sets at ``percent`` or more for every two groups that have such a pair.

    ``flat`` has the elements of the sets one after another. No pair across groups has both
    sets in the largest, so the sets outside it are compared with all.
    """
    n, of = len(size), np.repeat(np.arange(len(size)), size)
    element = np.unique(flat, return_inverse=True)[1]
    holders = of[np.argsort(element, kind="stable")]
    many = np.bincount(element)
    first, at = starts(many), starts(size)
    found = {}
    for x in np.flatnonzero(group != np.bincount(group).argmax()):
        mine = element[at[x] : at[x + 1]]
        both = np.bincount(holders[ragged_take(first[mine], many[mine])], minlength=n)
        for y in np.flatnonzero((100 * both >= percent * (size[x] + size - both)) & (group != group[x])):
            found.setdefault((min(group[x], group[y]), max(group[x], group[y])), (x, y))
    pairs = np.array([*found.values()], dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v), and of each the least node reachable from it."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while len(a):
        x, y = up[a], up[b]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))  # roots meet lesser roots
        while (up[up] != up).any():
            up = up[up]
        apart = up[a] != up[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[up]


def grouped(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(node, root) as by ``components``, written. Of up to ``most`` edges (16 MB) a single task makes the groups; more go through its rounds.

    ``edges`` (a, b) must be cheap to read: plain scans of what is written. A round is seven
    queries of many tasks each, whatever their rows, and the driver keeps a record of every one.
    """
    if edges.count() > most:
        return durable(components(edges))

    def run(batches):
        parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_reachable(*map(np.concatenate, zip(*parts)))], names=["node", "root"])

    return durable(edges.coalesce(1).mapInArrow(run, "node long, root long"))


def linked(marked: DataFrame, words: int = 5, percent: int = 80, few: int = 16, tile: int = 1024) -> DataFrame:
    """(node, root) of the sets of shingles joined to others by chains of similar pairs: all that share a variant.

    The sets under a variant first meet two of them: the one that shares most variants with
    others, which is near the middle of a family of copies, and the least. Where a
    variant then spans several groups, its pairs across groups are candidates if it has
    at most ``few`` sets; the sets of a larger one meet two further members. Variants of more than
    ``few`` sets that still span groups then have all their pairs across groups compared
    in tasks of two tiles of about ``tile`` sets, so that no similar pair under a variant is left apart.
    """
    texts = marked.select("node", "t")
    nodes = durable(marked.select("node", "size", "keys").dropDuplicates(["node"]))
    rows = nodes.count() * KEYS
    index = nodes.select(F.explode("keys").alias("key"), F.col("node").alias("a"), F.col("size").alias("sa"))
    held = durable(index.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = durable(met(index, held, ["key"], rows))
    score = shared.groupBy("a").agg(F.sum("n").alias("score"))
    shared = durable(shared.join(score.hint("merge"), "a").select("key", "a", "sa", "n", "score"))
    middle = durable(shared.groupBy("key").agg(F.first("n").alias("n"), F.max(F.struct("score", "a", "sa")).alias("p"), F.min(F.struct("a", "sa")).alias("q")))
    star = durable(met(shared.drop("n"), middle, ["key"], rows))

    def pairs_with(rows: DataFrame, *ends: str) -> DataFrame:
        found = [rows.filter(F.col("root") != F.col(f"{e}.root")) if "root" in rows.columns else rows for e in ends]
        found = [x.select("a", F.col(f"{e}.a").alias("b"), "sa", F.col(f"{e}.sa").alias("sb")) for x, e in zip(found, ends)]
        return found[0].unionByName(found[1])

    def spanning(candidates: DataFrame, roots: DataFrame) -> DataFrame:
        """The rows of variants that span groups, with their group and what is known of the variant."""
        rooted = candidates.join(roots.hint("merge"), F.col("a") == F.col("node"), "left").select("key", "a", "sa", F.coalesce("root", "a").alias("root"))
        drawn = F.xxhash64("a", F.lit(0)).alias("h")
        tiles = F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("sa") / (1 << 20))).cast("int").alias("tiles")  # of about 8 MB at most
        spans = rooted.groupBy("key").agg(F.count("*").alias("n"), tiles, F.min("root").alias("r"), F.max("root").alias("z"), F.min(F.struct(drawn, "a", "sa", "root")).alias("p"), F.max(F.struct("root", drawn, "a", "sa")).alias("q"))
        return durable(met(rooted, durable(spans.filter("r < z").drop("r", "z")), ["key"], rows))

    edges = similar(pairs_with(star, "p", "q"), texts, words, percent)
    roots = grouped(edges)
    open_rows = spanning(shared.select("key", "a", "sa"), roots)
    x, y = (open_rows.filter(F.col("n") <= few).select("key", "a", "sa", "root").alias(s) for s in "xy")
    across = x.join(y.hint("merge"), (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")))
    more = pairs_with(open_rows.filter(F.col("n") > few), "p", "q").unionByName(across.select("x.a", F.col("y.a").alias("b"), "x.sa", F.col("y.sa").alias("sb")))
    first, roots = roots, grouped(roots.toDF("a", "b").unionByName(similar(more, texts, words, percent)))  # groups are stars; new pairs join them
    forget(first)
    new = crossing(spanning(open_rows.filter(F.col("n") > few).select("key", "a", "sa"), roots).select("key", "a", "root", "tiles"), texts, words, percent)
    if new.isEmpty():
        return roots
    last = grouped(roots.toDF("a", "b").unionByName(new))
    forget(roots)
    return last


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the least id, nulls last.

    Near-duplicates share ``percent`` of their distinct lower-case word shingles or
    more, or are joined by a chain of such. Null, empty and blank texts are equal; a
    text shorter than a shingle is one shingle; of repeated rows one is kept; an empty
    table stays empty; columns of any names pass unchanged. Texts are shuffled once at most.
    """
    plain, name = plainly(docs)
    marked = durable(marked_texts(plain, docs.columns.index(text_col), words))
    view = marked.select("row", F.col(name[id_col]).alias("id"), full_text(F.col(name[text_col])).alias("t"), "node", "size", "keys")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row"))).alias("least")
    per_node = durable(view.groupBy("node").agg(least))
    rooted = per_node.join(linked(view, words, percent).hint("merge"), "node", "left")
    chosen = rooted.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least")).select(F.col("least.row").alias("row"))
    kept = marked.join(durable(chosen).hint("merge"), "row", "left_semi")
    return kept.select(*plain.columns).toDF(*docs.columns)
