r"""Operator 8: chat formatting with budgeted windows. DataFrame functions only.

Template: every turn is `<|role|>` newline text ` </s>` newline. In texts a backslash is set before each backslash and before each control string (`<s>`,
`</s>`, `<|`, `[INST]`, `[/INST]`); in roles `%` and `|` become `%25` and `%7C`. So no text or role can look like a mark, and both are read back exactly.

Windows: prefix sums of turn tokens (words of the text and a few marks) place each turn, whole, in window floor(tokens before / stride). A window starts with the
conversation's system turn, then repeats at most `history_turns` turns before its first new one, as long as they hold at most `history_tokens` tokens,
then has its new turns. The loss mask covers the texts of new assistant turns only, so a repeated target is never learned twice. A
turn longer than the budget stays whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table

# The control strings.
_CONTROL = r"(\\|</?s>|<\||\[/?INST\])"
_TURN = r"(?s)<\|(.*?)\|>\n(.*?) </s>\n"
MARK_TOKENS = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\|<|\[)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%7C"), F.lit("|")), F.lit("%25"), F.lit("%"))


def format_chats(
    turns: DataFrame, stride: int = 384, history_turns: int = 2, history_tokens: int = 128,
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """Per conversation and window: conv_id, window, formatted, loss_spans (start, stop in code points of formatted), fresh_from (where its new turns start).

    Turns are ordered by turn, then role and text (ties and repeated rows stay, one by one; null turns first). Null role and text count as empty, a null conv_id
    is a conversation of its own. Other columns are ignored; an empty table gives no rows. A conversation is put together in one task.
    """
    t = turns.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    t = t.withColumn("tokens", F.regexp_count("text", F.lit(WORD)).cast("long") + MARK_TOKENS)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("i", F.row_number().over(order)).withColumn(
        "before", F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    )
    t = t.withColumn("window", F.floor(F.col("before") / stride).cast("int"))
    # windows that repeat this turn: one that starts k turns later
    again = [
        F.when(
            (F.lead("window", k).over(order) != F.lead("window", k - 1).over(order)) & (F.lead("before", k).over(order) - F.col("before") <= history_tokens),
            F.lead("window", k).over(order),
        )
        for k in range(1, history_turns + 1)
    ]
    every = F.collect_set("window").over(Window.partitionBy("conv_id"))
    system = (F.col("i") == 1) & (F.col("role") == "system")
    t = t.withColumn(
        "others", F.when(system, F.array_remove(F.when(system, every), F.col("window"))).otherwise(F.array_compact(F.array(*again)))
    )
    placed = t.select("conv_id", "i", "role", "text", F.explode(F.concat(F.array("window"), "others")).alias("at"), (F.col("window")).alias("own"))
    head = F.concat(F.lit("<|"), escape_role(F.col("role")), F.lit("|>\n"))
    pieces = placed.select(
        "conv_id", F.col("at").alias("window"),
        F.struct("i", (F.col("at") == F.col("own")).alias("fresh"), (F.col("role") == "assistant").alias("target"), head.alias("head"), escape(F.col("text")).alias("body")).alias("p"),
    )
    grouped = pieces.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("p")).alias("p"))
    walked = F.expr(
        """aggregate(p, named_struct('at', 0, 'fresh', cast(null as int), 'loss', cast(array() as array<struct<start:int,stop:int>>)), (a, x) -> named_struct(
             'at', a.at + length(x.head) + length(x.body) + 6,
             'fresh', coalesce(a.fresh, if(x.fresh, a.at, null)),
             'loss', if(x.fresh AND x.target, concat(a.loss, array(named_struct('start', a.at + length(x.head), 'stop', a.at + length(x.head) + length(x.body)))), a.loss)))"""
    )
    return grouped.withColumn("w", walked).select(
        "conv_id",
        "window",
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(" </s>\n"))), "").alias("formatted"),
        F.col("w.loss").alias("loss_spans"),
        F.col("w.fresh").alias("fresh_from"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """Reads windows back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, windows."""
    fresh = F.expr("substring(formatted, fresh_from + 1)")
    roles = F.transform(F.regexp_extract_all(fresh, F.lit(_TURN), F.lit(1)), unescape_role)
    texts = F.transform(F.regexp_extract_all(fresh, F.lit(_TURN), F.lit(2)), unescape)
    lines = F.zip_with(roles, texts, lambda r, x: F.concat(r, F.lit("\n"), x, F.lit("\n")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"])))
    w = formatted.select(
        "conv_id",
        F.struct("window", F.size(roles).alias("n"), F.array_join(lines, "").alias("lines"), F.array_join(loss, "").alias("loss"), F.length("formatted").alias("chars")).alias("w"),
    )
    g = w.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))

    def total(field):
        return F.aggregate(F.transform("w", lambda x: x[field].cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)

    joined = F.array_join(F.col("w.loss"), "")
    return g.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(F.array_join(F.col("w.lines"), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(joined).cast("long").alias("loss_chars"),
        F.sha2(joined.cast("binary"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_chats(format_chats(turns))


OP8_SQL = r"""
WITH t0 AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t1 AS (
  SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens,
    length(text) + len(regexp_extract_all(text, '(\\|</?s>|<\||\[/?INST\])'))
      + length(replace(replace(role, '%', '%25'), '|', '%7C')) + 11 AS chars,
    row_number() OVER o AS i
  FROM t0 WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), t2 AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t1
), t3 AS (SELECT *, floor(before / 384) AS w FROM t2),
t4 AS (
  SELECT *, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(before, 1) OVER o AS b1, lead(before, 2) OVER o AS b2 FROM t3
  WINDOW o AS (PARTITION BY conv_id ORDER BY i)
), n AS (SELECT conv_id, count(DISTINCT w) AS windows FROM t3 GROUP BY conv_id),
copies AS (
  SELECT t4.*, CASE WHEN i = 1 AND role = 'system' THEN windows
    ELSE 1 + CASE WHEN w1 <> w AND b1 - before <= 128 THEN 1 ELSE 0 END + CASE WHEN w2 <> w1 AND b2 - before <= 128 THEN 1 ELSE 0 END END AS k
  FROM t4 JOIN n USING (conv_id)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars * k)::BIGINT AS formatted_chars
FROM copies GROUP BY conv_id
"""
