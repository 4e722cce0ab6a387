"""Quality rules with thresholds learned per language and source from mergeable quantile sketches.

DataFrame expressions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, durable, full_text, looked_up, plainly

# The statistics judged, and where their fences stand: "both" sides or the "high" side of all values; "rare"
# statistics are zero in most documents, so their quartiles are those of the documents that have any; "gap" statistics part
# two kinds of documents, so their fence stands in the widest gap of the upper tail.
RULES = {"symbol_rate": "gap", "dup_line_rate": "rare", "repeat_rate": "rare", "word_length": "both", "upper_rate": "high"}
TAIL = [0.75 + i / 100 for i in range(26)]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_in(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; none in a blank text."""
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t-\\r]+"))


def repeated_words(hashes: Column, width: int) -> Column:
    """Words covered by windows whose hash occurs twice or more, given the hash of each window in order."""

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda p, q: F.least(F.lit(width), F.coalesce(q - p, F.lit(width))))
        return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

    def doubled(s: Column) -> Column:
        pairs = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(hashes) < 2, F.lit(0)).when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(ordered, doubled), covered))


def measured(docs: DataFrame, text_col: str = "text", width: int = 8) -> DataFrame:
    """``docs`` with the base counts and the rates that the rules judge, in columns that start with ``_``.

    Null and blank texts count as no words and have rates of zero; other columns pass.
    """
    text = full_text(F.col(text_col))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    out = docs.withColumns({"_words": words_in(text), "_lines": lines})
    positions = F.when(F.size("_words") >= width, F.sequence(F.lit(1), F.size("_words") - width + 1)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("_hashes", F.transform(positions, lambda i: F.xxhash64(F.slice(F.col("_words"), i, width))))
    letters = F.length(F.regexp_replace(text, "[^A-ZÀ-ÖØ-Þ]+", ""))
    out = out.select(
        *docs.columns,
        F.size("_words").cast("long").alias("_n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("_word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("_n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        repeated_words(F.col("_hashes"), width).cast("long").alias("_n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
        letters.alias("_upper"),
    )
    n, lines_n, chars = F.greatest("_n_words", F.lit(1)), F.greatest("_n_lines", F.lit(1)), F.greatest("_word_chars", F.lit(1))
    return out.withColumns(
        {
            "_symbol_rate": F.col("_n_symbols") / n,
            "_dup_line_rate": F.col("_n_dup_lines") / lines_n,
            "_repeat_rate": F.col("_n_repeat_words") / n,
            "_word_length": F.col("_word_chars") / n,
            "_upper_rate": F.col("_upper") / chars,
        }
    ).drop("_n_lines", "_upper")


def failed(shortest: int = 20, most_repeats: int = 30) -> Column:
    """The fixed rule that holds before any learned one."""
    return (F.col("_n_words") < shortest) | (100 * F.col("_n_repeat_words") > most_repeats * F.col("_n_words"))


def fences(measures: DataFrame, reach: float = 3.0, enough: int = 200, k: int = 200, enough_rare: int = 50) -> DataFrame:
    """Per ``_lang`` and ``_source``, the bounds of every rule and ``n``, the documents judged.

    Each task sketches its own rows (KLL, size ``k``), so a hot source costs one sketch a
    task; sketches of sources merge into those of languages and of everything. A bound
    is a quartile moved outwards by ``reach`` interquartile ranges; nothing is added. Of
    a "rare" statistic the quartiles are those of its values above zero. Of a "gap"
    statistic the bound moves up from there to the middle (by ratio, one symbol in a
    text of median length being the unit) of the widest gap between neighbouring
    percentiles of the upper tail, where one is wider than a factor of two.
    A source with fewer than ``enough`` documents (``enough_rare`` above zero) in a
    language borrows the sketches of the language, and that of everything where the
    language is small as well; a rare statistic that few documents of all have has no fence.
    """
    names = [*RULES, "n_words"]
    value = {r: F.when(F.col(f"_{r}") > 0, F.col(f"_{r}")) if RULES.get(r) == "rare" else F.col(f"_{r}").cast("double") for r in names}
    own = measures.groupBy("_lang", "_source").agg(F.count("*").alias("n"), *(F.count(value[r]).alias(f"n_{r}") for r in names), *(F.kll_sketch_agg_double(value[r], F.lit(k)).alias(r) for r in names))
    own = durable(own)

    def merged(by, mark):
        return own.groupBy(by).agg(*(F.sum(f"n_{r}").alias(f"n_{r}_{mark}") for r in names), *(F.kll_merge_agg_double(r, F.lit(k)).alias(f"{r}_{mark}") for r in names))

    joined = own.join(merged("_lang", "lang"), "_lang").withColumn("one", F.lit(1)).join(merged(F.lit(1).alias("one"), "all"), "one")

    def sketch(r: str) -> Column:
        least = enough_rare if RULES.get(r) == "rare" else enough
        nearest = F.when(F.col(f"n_{r}") >= least, F.col(r)).when(F.col(f"n_{r}_lang") >= least, F.col(f"{r}_lang"))
        return nearest.when(F.col(f"n_{r}_all") >= least, F.col(f"{r}_all")) if RULES.get(r) == "rare" else nearest.otherwise(F.col(f"{r}_all"))

    def quantile(r: str, at: float) -> Column:
        return F.kll_sketch_get_quantile_double(sketch(r), F.lit(at).cast("double"))

    def in_gap(r: str, high: Column) -> Column:
        tail, unit = F.kll_sketch_get_quantile_double(sketch(r), F.array(*(F.lit(x).cast("double") for x in TAIL))), 1.0 / quantile("n_words", 0.5)

        def widest(t: Column) -> Column:
            gaps = F.zip_with(F.slice(t, 1, len(TAIL) - 1), F.slice(t, 2, len(TAIL) - 1), lambda x, y: F.struct(F.when(y > high, (y + unit) / (x + unit)).otherwise(0.0).alias("ratio"), (F.sqrt((x + unit) * (y + unit)) - unit).alias("middle")))
            return F.array_max(gaps)

        return let(let(tail, widest), lambda g: F.when(g["ratio"] > 2, F.greatest(high, g["middle"])).otherwise(high))

    bounds = []
    for r, side in RULES.items():
        low, high = quantile(r, 0.25), quantile(r, 0.75)
        most = high + reach * (high - low)
        bounds.append((in_gap(r, most) if side == "gap" else most).alias(f"{r}_most"))
        if side == "both":
            bounds.append((low - reach * (high - low)).alias(f"{r}_least"))
    return joined.select("_lang", "_source", "n", *bounds)


def judged(docs: DataFrame, names: dict[str, str], lang_col: str, source_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` (plain, see ``plainly``) with base counts, ``_failed`` and ``_kept``."""
    lang, source, text = names[lang_col], names[source_col], names[text_col]
    marks = {"_lang": F.coalesce(F.col(lang).cast("string"), F.lit("")), "_source": F.coalesce(F.col(source).cast("string"), F.lit(""))}
    m = measured(docs.select(*keep, *(c for c in [text] if c not in keep), *(v.alias(k) for k, v in marks.items())), text)
    m = durable(m if text in keep else m.drop(text)).withColumn("_failed", failed())
    out = looked_up(m, durable(fences(m.filter(~F.col("_failed")))), ["_lang", "_source"])
    fine = F.lit(True)
    for r, side in RULES.items():
        fine = fine & F.coalesce(F.col(f"_{r}") <= F.col(f"{r}_most"), F.lit(True))
        if side == "both":
            fine = fine & F.coalesce(F.col(f"_{r}") >= F.col(f"{r}_least"), F.lit(True))
    return out.withColumn("_kept", ~F.col("_failed") & fine)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A document fails the base rule, or falls beyond a fence learned from the
    documents of its language and source that pass it. Null and blank texts have no
    words and fail; null languages and sources form groups of their own with the empty
    name; repeated rows get a row each; values equal to a fence pass; an empty table
    gives no rows; further columns, whatever their names, are not read.
    """
    plain, names = plainly(docs)
    out = judged(plain, names, lang_col, source_col, text_col, [names[id_col]])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(F.col(names[id_col]).alias(id_col), *(F.col(f"_{c}").alias(c) for c in counts), F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that a rule rejects; columns of any names stay as they are. Rows are judged as by ``quality_rules``."""
    plain, names = plainly(docs)
    return judged(plain, names, lang_col, source_col, text_col, plain.columns).filter("_kept").select(*plain.columns).toDF(*docs.columns)
