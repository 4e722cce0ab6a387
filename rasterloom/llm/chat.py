"""Chat formatting in budgeted windows, and the exact way back.

DataFrame expressions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The template of a turn, and what stands for its control characters inside texts.
OPEN, SHUT = "<turn ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))  # a backslash is always followed by b, l or g


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def turn_tokens(text: Column) -> Column:
    """A turn's budgeted size: a token for four characters begun, and four for its marks."""
    return F.expr("0").cast("long") + F.floor((F.length(text) + 3) / 4).cast("long") + 4


def spans(turns: DataFrame, budget: int, history: int, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns with their place, tokens before them, and the window in which each is new."""
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("tokens", turn_tokens(F.col("text")))
    order = W.partitionBy("conv").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("system", (F.col("place") == 1) & (F.col("role") == "system"))
    cost = F.when(F.col("system"), F.lit(0)).otherwise(F.col("tokens"))
    rows = rows.withColumn("before", F.sum(cost).over(order.rowsBetween(W.unboundedPreceding, 0)) - cost)
    first = F.max(F.when(F.col("system"), F.col("tokens")).otherwise(F.lit(0))).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("half", F.greatest(F.lit(32), F.floor((F.lit(budget - history) - first) / 2)).cast("long"))
    rows = rows.withColumn("bucket", F.floor(F.col("before") / F.col("half"))).withColumn("long", ~F.col("system") & (F.col("tokens") > F.col("half")))
    opens = (F.col("place") == 1) | (~F.lag("system").over(order) & ((F.col("bucket") != F.lag("bucket").over(order)) | F.col("long") | F.lag("long").over(order)))
    return rows.withColumn("window", F.sum(opens.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("bucket", "long")


def format_chat(turns: DataFrame, budget: int = 1024, history: int = 256, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per window: conversation, window (from 1), n_turns, n_context, text, loss.

    Prefix sums of turn tokens choose windows along turns. A leading system turn opens
    every window; up to ``history`` tokens of turns before the window follow; then its
    new turns. ``n_context`` counts the turns repeated from before. ``loss`` holds start
    (from 0) and length, in code points of ``text``, of the new assistant texts: each
    assistant text is in the loss of one window. A window holds at most ``budget``
    tokens unless one turn, or the system turn, alone is larger: turns are never cut.

    Null roles and texts are empty; turns of one number are ordered by role and text, and
    repeated rows are turns of their own; null turn numbers come first; rows of null
    conversations form one conversation; an empty table gives no rows; further columns
    are not read. Windows, not conversations, are gathered into rows; the turns of a
    conversation are ordered in one task, which spills and holds a window at a time.
    """
    kept = spans(turns, budget, history, conv_col, turn_col, role_col, text_col)
    body = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(">"))
    kept = kept.withColumns({"head": F.length(body).cast("long"), "piece": F.concat(body, escape(F.col("text")), F.lit(SHUT))})
    kept = kept.withColumn("size", F.length("piece").cast("long")).withColumn("reach", F.least(F.lit(history).cast("long"), F.col("half")))
    # A turn is told where the next windows begin and names those that repeat it. No more
    # than four begin within half a window's tokens, so four are tried. Texts move once, to their conversation.
    by_window, whole = W.partitionBy("conv").orderBy("window"), W.partitionBy("conv")
    begins = F.when(~F.col("system"), F.col("before"))
    kept = kept.withColumns({f"start{i}": F.min(begins).over(by_window.rangeBetween(i, i)) for i in range(1, 5)}).withColumn("last", F.max("window").over(whole))
    into = lambda window, again: F.struct(window.cast("long").alias("window"), F.lit(again).alias("again"))
    repeats = F.filter(F.array(*(F.when(F.col(f"start{i}") - F.col("before") <= F.col("reach"), into(F.col("window") + i, True)) for i in range(1, 5))), lambda x: x.isNotNull())
    each = F.transform(F.sequence(F.lit(2).cast("long"), F.col("last")), lambda x: into(x, True))
    targets = F.concat(F.array(into(F.col("window"), False)), F.when(~F.col("system"), repeats).when(F.col("last") > 1, each).otherwise(F.filter(repeats, lambda x: F.lit(False))))
    every = kept.withColumn("to", F.explode(targets)).select("conv", "to.window", "place", "to.again", "role", "head", "size", "piece")
    out = every.groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct("place", "again", "role", "head", "size", "piece"))).alias("t"))
    starts = F.transform(F.col("t"), lambda x, i: F.aggregate(F.slice(F.col("t"), F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + y["size"]))
    out = out.withColumn("at", starts)
    marked = F.zip_with("t", "at", lambda x, a: F.when(~x["again"] & (x["role"] == "assistant"), F.struct((a + x["head"]).alias("start"), (x["size"] - x["head"] - len(SHUT)).alias("length"))))
    return out.select(
        F.col("conv").alias(conv_col),
        "window",
        F.size("t").cast("long").alias("n_turns"),
        F.size(F.filter("t", lambda x: x["again"])).cast("long").alias("n_context"),
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("text"),
        F.filter(marked, lambda x: x.isNotNull()).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Windows with their new turns parsed from the text, and the texts under the loss mask."""
    pieces = F.filter(F.split("text", SHUT), lambda x: x != "")
    new = F.slice(pieces, F.col("n_context").cast("int") + 1, F.greatest(F.size(pieces), F.lit(1)))

    def parsed(piece: Column) -> Column:
        rest = F.substring(piece, len(OPEN) + 1, 1 << 30)
        role = F.substring_index(rest, ">", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(rest, F.length(role) + 2, F.lit(1 << 30))).alias("text"))

    loss = F.transform("loss", lambda x: unescape(F.substring(F.col("text"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    return windows.withColumns({"new_turns": F.transform(new, parsed), "loss_texts": loss})


def digests(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, what its windows read back to. A digest needs a conversation's text in one row."""
    rows = read_back(windows).select(
        F.col(conv_col).alias("conv"),
        "window",
        F.size("new_turns").cast("long").alias("n"),
        F.array_join(F.transform("new_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("loss_texts", "").alias("loss"),
        F.length("text").cast("long").alias("chars"),
    )
    whole = rows.groupBy("conv").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    whole = whole.withColumn("all_loss", F.array_join(F.transform("w", lambda x: x["loss"]), ""))
    return whole.select(
        F.col("conv").alias(conv_col),
        "n_turns",
        F.sha2(F.array_join(F.transform("w", lambda x: x["turns"]), ""), 256).alias("turns_sha256"),
        F.length("all_loss").cast("long").alias("loss_chars"),
        F.sha2("all_loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The same digests in SQL, from the turns themselves, over ``conversations`` and conversation -7.
ORACLE = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), a as (
  select *, (length(text) + 3) // 4 + 4 as tokens, row_number() over w as place from t
  window w as (partition by conv_id order by turn, role, text)
), b as (
  select *, place = 1 and role = 'system' as sys,
    length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) + 15 as size from a
), c as (
  select *, sum(case when sys then 0 else tokens end) over w - (case when sys then 0 else tokens end) as before,
    max(case when sys then tokens else 0 end) over w as head from b
  window w as (partition by conv_id order by place rows unbounded preceding)
), d as (
  select *, greatest(32, cast(floor((768 - head) / 2.0) as bigint)) as half from c
), e as (
  select *, before // half as bucket, not sys and tokens > half as big from d
), f as (
  select *, case when place = 1 then 1 when lag(sys) over w then 0
      when bucket <> lag(bucket) over w or big or lag(big) over w then 1 else 0 end as opens from e
  window w as (partition by conv_id order by place)
), g as (
  select *, sum(opens) over (partition by conv_id order by place rows unbounded preceding) as win from f
), h as (
  select conv_id, win, min(before) filter (where not sys) as start from g group by all
), again as (
  select g.conv_id, sum(g.size) as size from g join h on g.conv_id = h.conv_id
  where (not g.sys and h.win > g.win and h.start - g.before <= least(256, g.half)) or (g.sys and h.win > 1) group by 1
)
select g.conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by place) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(g.size) + coalesce(any_value(again.size), 0) as bigint) as formatted_chars
from g left join again on g.conv_id = again.conv_id group by 1
"""
