"""Fences of op5 follow the documents of a language and source."""

from rasterloom.llm import quality_rules


def text(seed, n, repeated):
    """``n`` words, of which about ``repeated`` lie in a passage that occurs twice."""
    half = repeated // 2
    w = [f"w{seed:04d}x{j}" for j in range(n - half)]
    return " ".join(w[:half] + w)


def test_repeat_fence_lies_below_the_base_rule_and_differs_by_group(spark):
    rows = [(i, text(i, 200, 20 + 2 * (i % 5) if i < 100 else 0), "en", "quiet") for i in range(400)]
    rows += [(1000 + i, text(1000 + i, 200, 48 + 2 * (i % 3) if i < 100 else 0), "en", "loud") for i in range(400)]
    rows += [(2000, text(2000, 200, 50), "en", "quiet"), (2001, text(2001, 200, 50), "en", "loud")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert not got[2000].base_failed and not got[2000].kept  # repeats of a quarter are common in the other source only
    assert got[2001].kept and all(got[i].kept for i in [*range(400), *range(1000, 1400)])
