"""Conversations as training text, in Spark expressions only.

Template: adjacent turns of one role form a block, its turns set apart by
``[TURN]``. An assistant block is ``<s>`` texts ``</s>``, any other block is
``[INST]`` role ``[ROLE]`` texts ``[/INST]``. Every mark begins with ``[`` or
``<``; inside roles and texts a backslash is doubled and ``[`` and ``<`` get a
backslash behind them, so no mark can occur there and the text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the template (fixed values).
USER_OPEN, ROLE_END, USER_CLOSE = "[INST]", "[ROLE]", "[/INST]"
REPLY_OPEN, REPLY_CLOSE = "<s>", "</s>"
NEXT_TURN = "[TURN]"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("["), F.lit("[\\")), F.lit("<"), F.lit("<\\"))


def unescaped(text: Column) -> Column:
    marks = F.replace(F.replace(text, F.lit("<\\"), F.lit("<")), F.lit("[\\"), F.lit("["))
    return F.replace(marks, F.lit("\\\\"), F.lit("\\"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per ``conv_id``: ``segments`` and ``formatted``.

    ``segments`` is an array of (text, loss) whose texts, put together, are
    ``formatted``; ``loss`` marks the assistant's texts. Turns are ordered by
    turn number, then role, then text, nulls first; repeated rows are repeated
    turns. A null text or role is empty, a null ``conv_id`` is a conversation of
    its own. Other columns are ignored; an empty table gives no rows. A
    conversation is one string of the output and so must fit into one (2 GB).
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    ordered = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns")
    )
    # positions at which a run of one role begins
    starts = F.filter(
        F.transform("turns", lambda t, i: F.when((i == 0) | (F.get("turns", i - 1)["role"] != t["role"]), i)),
        lambda i: i.isNotNull(),
    )
    runs = ordered.withColumn("starts", starts).withColumn(
        "runs",
        F.transform(
            "starts",
            lambda start, k: F.slice(
                "turns",
                start + 1,
                F.coalesce(F.get("starts", k + 1), F.size("turns")) - start,
            ),
        ),
    )
    segments = F.flatten(F.transform("runs", _segments_of_run))
    return runs.select("conv_id", segments.alias("segments")).select(
        "conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted")
    )


def _segments_of_run(run: Column) -> Column:
    role = F.get(run, F.lit(0))["role"]
    reply = role == ASSISTANT

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    head = segment(F.when(reply, F.lit(REPLY_OPEN)).otherwise(F.concat(F.lit(USER_OPEN), escaped(role), F.lit(ROLE_END))), no)
    tail = segment(F.when(reply, F.lit(REPLY_CLOSE)).otherwise(F.lit(USER_CLOSE)), no)
    texts = F.transform(
        run,
        lambda t, i: F.array(
            segment(F.when(i == 0, F.lit("")).otherwise(F.lit(NEXT_TURN)), no),
            segment(escaped(t["text"]), reply),
        ),
    )
    return F.concat(F.array(head), F.flatten(texts), F.array(tail))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    # every block begins with its opening mark, and no mark occurs inside a text
    blocks = F.filter(F.split(formatted, r"(?=\[INST\]|<s>)"), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        reply = F.startswith(block, F.lit(REPLY_OPEN))
        inner = F.substring(
            block,
            F.when(reply, F.lit(len(REPLY_OPEN) + 1)).otherwise(F.lit(len(USER_OPEN) + 1)),
            F.char_length(block)
            - F.when(reply, F.lit(len(REPLY_OPEN + REPLY_CLOSE))).otherwise(F.lit(len(USER_OPEN + USER_CLOSE))),
        )
        role = F.when(reply, F.lit(ASSISTANT)).otherwise(unescaped(F.split_part(inner, F.lit(ROLE_END), F.lit(1))))
        texts = F.when(reply, inner).otherwise(F.split_part(inner, F.lit(ROLE_END), F.lit(2)))
        return F.transform(
            F.split(texts, r"\[TURN\]"), lambda text: F.struct(role.alias("role"), unescaped(text).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns_of))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what is read back from ``format_conversations``."""
    turn_lines = F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    return (
        formatted.withColumn("read", read_back(F.col("formatted")))
        .withColumn("loss_text", F.array_join(loss, ""))
        .select(
            "conv_id",
            F.size("read").cast("long").alias("n_turns"),
            F.sha2(F.array_join(turn_lines, ""), 256).alias("turns_sha256"),
            F.char_length("loss_text").cast("long").alias("loss_chars"),
            F.sha2("loss_text", 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
        )
    )


#: The same result for another engine; the length of the output follows from the template.
CHAT_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked AS (
    SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after, row_number() OVER w AS k,
           length(text) + length(regexp_replace(text, '[^\\\[<]', '', 'g')) AS text_length,
           length(role) + length(regexp_replace(role, '[^\\\[<]', '', 'g')) AS role_length
    FROM turns
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(text_length
           + CASE WHEN before = role THEN 6 WHEN role = 'assistant' THEN 3 ELSE 12 + role_length END
           + CASE WHEN after = role THEN 0 WHEN role = 'assistant' THEN 4 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
