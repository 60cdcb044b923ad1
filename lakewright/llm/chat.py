"""Chat formatting from event logs, with DataFrame functions only.

Events are partitioned by conversation and sorted by sequence. A message is
the last whole text set for it (``message``, ``regenerate`` or ``edit``)
followed by the ``delta`` texts that came after; ``delete`` sets none. Final
messages are rendered between turn markers and read back exactly.

Control strings inside texts are quoted by one backslash after their first
character; control strings that already hold backslashes there get one more,
so quoting is undone by taking one away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewright.llm.common import table

TURN, END = "<|im_start|>", "<|im_end|>\n"
#: The control strings of common chat templates.
CONTROL = r"/?s>|<SYS>>|</SYS>>|\|[A-Za-z0-9_]+\|>|/?INST\]|/?(?:AVAILABLE_TOOLS|TOOL_CALLS|TOOL_RESULTS)\]"
QUOTE = rf"([<\[])(\\*)({CONTROL})"
UNQUOTE = rf"([<\[])\\(\\*)({CONTROL})"


def quote(text: Column) -> Column:
    return F.regexp_replace(text, QUOTE, r"$1\\$2$3")


def unquote(text: Column) -> Column:
    return F.regexp_replace(text, UNQUOTE, "$1$2$3")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of (conv_id, msg, seq, op, role, text).

    Returns conv_id, msg, first_seq, role, text. Null text counts as empty, a
    null op as ``message``; the role is the last one that is not null. Events
    with equal seq are taken in the order message, edit, regenerate, delta,
    delete, then by text. A conversation stays on one task, for its order is
    part of the result; its events are bounded by what one text may hold.
    """
    op = F.coalesce(F.col("op"), F.lit("message"))
    kind = F.array_position(F.array(*map(F.lit, ("message", "edit", "regenerate", "delta", "delete"))), op)
    e = events.select(
        "conv_id", "msg", F.struct(F.col("seq"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role").alias("e")
    )
    g = e.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list("e")).alias("es"))
    g = g.withColumn(
        "base",
        F.array_max(F.transform("es", lambda x, i: F.when(x["kind"] != 4, i + 1).otherwise(F.lit(0)))),
    )
    parts = F.filter(F.col("es"), lambda x, i: (i + 1 >= F.col("base")) & (x["kind"] != 5))
    roles = F.filter(F.transform("es", lambda x: x["role"]), lambda r: r.isNotNull())
    gone = (F.col("base") > 0) & (F.element_at("es", F.greatest("base", F.lit(1)))["kind"] == 5) & (F.size(parts) == 0)
    return g.filter(~gone).select(
        "conv_id",
        "msg",
        F.element_at("es", 1)["seq"].alias("first_seq"),
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    Spans are code points of ``formatted``, end exclusive, and cover the quoted
    texts of ``loss_role``.
    """
    order = W.partitionBy("conv_id").orderBy("first_seq", "msg")
    m = messages.withColumn("head", F.concat(F.lit(TURN), F.url_encode("role"), F.lit("\n")))
    m = m.withColumn("body", quote(F.col("text")))
    m = m.withColumn("piece", F.concat("head", "body", F.lit(END)))
    m = m.withColumn("till", F.sum(F.length("piece").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    m = m.withColumn("at", F.row_number().over(order))
    stop = F.col("till") - len(END)
    span = F.struct((stop - F.length("body")).alias("start"), stop.alias("end"))
    g = m.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "piece", "role", span.alias("span")))).alias("turns")
    )
    loss = F.filter("turns", lambda t: t["role"] == loss_role)
    return g.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(loss, lambda t: t["span"]).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and loss_text, read from the output alone."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 2**30)
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            F.url_decode(F.substring_index(p, "\n", 1)).alias("role"),
            unquote(
                F.substr(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END))
            ).alias("text"),
        ),
    )
    masked = F.transform(
        "loss_spans",
        lambda s: unquote(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
    )
    return formatted.withColumn("turns", turns).withColumn("loss_text", F.array_join(masked, ""))


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans of an event log (see ``fold_events``).

    A null conv_id is a conversation of its own; an empty log gives no rows;
    repeated events are kept; other columns are ignored.
    """
    return render(fold_events(events), loss_role)


def events_of_turns(rows: DataFrame) -> DataFrame:
    """Each row of (conv_id, turn, role, text) as a message event of its own.

    Rows that share a turn, repeated rows too, stay apart, in order of role
    and text.
    """
    at = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select(
        "conv_id",
        F.row_number().over(at).alias("msg"),
        F.row_number().over(at).cast("long").alias("seq"),
        F.lit("message").alias("op"),
        "role",
        "text",
    )


#: The conversation that quotes control strings.
PROBE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    out = read_back(format_chats(events_of_turns(rows.unionByName(probe))))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = r"""regexp_replace(text, '([<\[])(\\*)(/?s>|<SYS>>|</SYS>>|\|[A-Za-z0-9_]+\|>|/?INST\]|/?(?:AVAILABLE_TOOLS|TOOL_CALLS|TOOL_RESULTS)\])', '\1\\\2\3', 'g')"""
ORACLE = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(url_encode(role)) + 1 + length({_ESC}) + 11) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
