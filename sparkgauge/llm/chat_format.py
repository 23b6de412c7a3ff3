"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role become one message, and the
messages are concatenated under a template:

    <|im_start|>ROLE<|im_sep|>TEXT<|im_next|>TEXT<|im_end|>

``<|im_next|>`` stands between the texts of merged turns. Inside roles and texts every control string is broken up with a
backslash (and every backslash is doubled), so none can be taken for the template's own and unescape() restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.llm.common import table

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"
#: What could be read as control: the template's own marks (all begin with <|) and those of other common templates.
CONTROL = r"(<)(?=\||/?s>|</?SYS>>)|(\[)(?=/?INST\])"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, "$1$2\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    learn_from: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """(conv, n_turns, formatted, segments): a row per conversation.

    ``segments`` is an array of (piece, loss); the pieces concatenated are ``formatted``, and ``loss`` says whether a
    piece is learnt from: the texts of ``learn_from`` roles and nothing else, so marks and escaping of other roles never
    are. Turns are ordered by turn, then role and text; a null turn comes first, null roles and texts count as empty,
    rows with a null conversation form one conversation, repeated rows are repeated turns, and turns with the same number are
    ordered by role and text. A conversation is one row of output, so its turns, however many and long, meet in one task.
    Further columns of any name aren't looked at; an empty table gives an empty one.
    """
    one = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    grouped = turns.groupBy(F.col(conv_col).alias("conv")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    n = F.size("turns")
    at = F.sequence(F.lit(0), n - 1)
    starts = F.filter(at, lambda i: (i == 0) | (F.get("turns", i).getField("role") != F.get("turns", i - 1).getField("role")))
    runs = grouped.select("conv", n.cast("long").alias("n_turns"), "turns", starts.alias("starts"))

    def message(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        return F.struct(F.get("turns", start).getField("role").alias("role"), F.slice("turns", start + 1, end - start).alias("said"))

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("piece"), loss.alias("loss"))

    def pieces(message: Column) -> Column:
        learnt = message.getField("role").isin(*learn_from)
        head = F.concat(F.lit(START), escape(message.getField("role")), F.lit(SEP))
        body = F.flatten(
            F.transform(
                message.getField("said"),
                lambda turn, i: F.array(
                    piece(F.when(i == 0, head).otherwise(F.lit(NEXT)), F.lit(False)), piece(escape(turn.getField("text")), learnt)
                ),
            )
        )
        return F.concat(body, F.array(piece(F.lit(END), F.lit(False))))

    messages = runs.select("conv", "n_turns", F.transform("starts", message).alias("messages"))
    segments = messages.select("conv", "n_turns", F.flatten(F.transform("messages", pieces)).alias("segments"))
    return segments.select("conv", "n_turns", F.array_join("segments.piece", "").alias("formatted"), "segments")


def parse_chat(formatted: Column) -> Column:
    """The turns in a formatted conversation: array of (role, text), one for each turn that went in."""
    messages = F.filter(F.split(formatted, r"<\|im_end\|>", -1), lambda m: m != "")

    def turns(message: Column) -> Column:
        bare = F.substr(message, F.lit(len(START) + 1))
        halves = F.split(bare, r"<\|im_sep\|>", 2)
        role = unescape(F.get(halves, F.lit(0)))
        return F.transform(
            F.split(F.get(halves, F.lit(1)), r"<\|im_next\|>", -1),
            lambda text: F.struct(role.alias("role"), unescape(text).alias("text")),
        )

    return F.flatten(F.transform(messages, turns))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")
    )
    chats = format_chats(turns.unionByName(extra))
    read = chats.select("conv", parse_chat(F.col("formatted")).alias("read"), "formatted", "segments")
    told = F.array_join(F.transform("read", lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n"))), "")
    learnt = F.transform(F.filter("segments", lambda s: s.getField("loss")), lambda s: unescape(s.getField("piece")))
    digests = read.select(
        "conv", F.size("read").cast("long").alias("n_turns"), told.alias("told"), F.array_join(learnt, "").alias("learnt"), "formatted"
    )
    return digests.select(
        F.col("conv").alias("conv_id"),
        "n_turns",
        F.sha2(F.encode("told", "UTF-8"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.encode("learnt", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, row_number() OVER w AS n, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS opens,
    length(text) + len(regexp_extract_all(text, '<\||</?s>|<</?SYS>>|\[/?INST\]|\\')) AS text_size,
    length(role) + len(regexp_extract_all(role, '<\||</?s>|<</?SYS>>|\[/?INST\]|\\')) AS role_size
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_size + CASE WHEN opens = 1 THEN 12 + role_size + 10 + 10 ELSE 11 END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
