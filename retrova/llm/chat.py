"""Chat formatting by event sourcing, with DataFrame functions only.

A log holds events (conversation, message, sequence, kind, role, text). A message is the fold of its events in sequence order:
`delta` appends its text, `edit` puts its text in place of all so far, `regenerate` starts over (with its text, if it has
any). The role is that of the last event that names one. Messages render in order of their message number.

Plan: messages fold first, dealt by (conversation, message), so the events of one long conversation spread; then one row a
message meets by conversation. Both steps combine on the map side.

Template: `### User: text</turn>` and a line feed a turn. Inside texts and roles a backslash becomes two, `#` becomes `\\#` and
`</turn>` becomes `<\\/turn>`; so no text holds a mark, and taking one backslash off each pair restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._fold import collected
from ._spark import table

END = "</turn>\n"
#: Roles with a name of their own in the template; others stand as role=name, with colons escaped too.
ROLES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
TURN = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#")), F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _heading(role: Column) -> Column:
    out = F.concat(F.lit("role="), F.replace(escape(role), F.lit(":"), F.lit("\\:")))
    for name, shown in ROLES.items():
        out = F.when(role == name, F.lit(shown)).otherwise(out)
    return out


def _role(heading: Column) -> Column:
    out = unescape(F.substring(heading, 6, F.length(heading)))
    for name, shown in ROLES.items():
        out = F.when(heading == shown, F.lit(name)).otherwise(out)
    return out


def render(turns: Column) -> Column:
    """The formatted text of an array of (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("### "), _heading(t["role"]), F.lit(": "), escape(t["text"]), F.lit(END))), "")


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text: the inverse of render."""
    head = r"(?s)\A### ((?:[^:\\]|\\.)*): (.*)\z"
    each = F.filter(F.split(formatted, END, -1), lambda t: t != "")
    return F.transform(each, lambda t: F.struct(_role(F.regexp_extract(t, head, 1)).alias("role"), unescape(F.regexp_extract(t, head, 2)).alias("text")))


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """The text under the loss mask: every text of that role once, in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")


def loss_spans(formatted: Column, role: str = "assistant") -> Column:
    """Spans [start, end) of the formatted text, in code points, whose (escaped) text the loss covers."""
    mark = F.lit(f"### {ROLES.get(role, 'role=' + role)}: ")

    def step(at: Column, turn: Column) -> Column:
        end = at + F.length(turn)
        own = F.array(F.struct((at + F.length(mark)).alias("start"), end.alias("end")))
        none = F.array().cast("array<struct<start:int,end:int>>")
        return F.struct((end + len(END)).alias("at"), F.when(F.startswith(turn, mark), own).otherwise(none).alias("out"))

    turns = F.filter(F.split(formatted, END, -1), lambda t: t != "")
    return collected(turns, F.lit(0), step, "struct<start:int,end:int>")["out"]


def fold(events: DataFrame) -> DataFrame:
    """Messages (conv_id, message, role, text) of events (conv_id, message, seq, kind, role, text).

    Null texts are empty. Ties in the sequence fold by kind, then role and text; repeated events fold once each. Messages
    without an event that starts them are started by their first delta; unknown kinds count as `delta`. An empty log folds to
    no message.
    """
    event = F.struct("seq", F.coalesce("kind", F.lit("delta")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    log = F.sort_array(F.collect_list(event))
    rows = events.groupBy("conv_id", "message").agg(log.alias("log"))
    last = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i).otherwise(F.lit(0))))
    live = F.slice("log", last + 1, F.size("log"))
    named = F.filter("log", lambda e: e["role"].isNotNull())
    return rows.select("conv_id", "message", F.when(F.size(named) > 0, F.element_at(named, -1)["role"]).alias("role"), F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def format_conversations(events: DataFrame) -> DataFrame:
    """(conv_id, formatted) of events (conv_id, message, seq, kind, role, text): every conversation rendered.

    A null role renders as an empty name and reads back as one; a null conversation is one of its own; messages without a
    number come first. A conversation's result is one text, so its turns meet in one row at last, and only then.
    """
    turn = F.struct("message", F.coalesce("role", F.lit("")).alias("role"), "text")
    turns = fold(events).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return turns.select("conv_id", render(F.col("turns")).alias("formatted"))


def events_of(turns: DataFrame) -> DataFrame:
    """A log of finished turns (conv_id, turn, role, text): each row is a message of one delta.

    Rows that repeat a conversation's turn number stay messages of their own, in the order of role and text; n equal rows are
    counted on the map side and numbered, so that they give n messages. Null roles and texts are empty.
    """
    value = lambda c: F.coalesce(c, F.lit("")).alias(c)
    counted = turns.groupBy("conv_id", "turn", value("role"), value("text")).agg(F.count("*").alias("n"))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.select("conv_id", F.struct("turn", "role", "text", "copy").alias("message"), F.lit(0).cast("long").alias("seq"), F.lit("delta").alias("kind"), "role", "text")


#: A conversation whose texts hold the template's own marks.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and PROBE, formatted; the digests are read back from the formatted text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    out = format_conversations(events_of(turns)).withColumn("back", parse(F.col("formatted")))
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("back"))
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same rows by SQL over the conversations themselves; formatted_chars counts marks and escapes.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT *, CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length(role)
                 ELSE 5 + length(role) + length(regexp_replace(role, '[^\\#:]', '', 'g')) + (length(role) - length(replace(role, '</turn>', ''))) // 7 END AS heading,
    length(text) + length(regexp_replace(text, '[^\\#]', '', 'g')) + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS body
  FROM c
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(heading + body + 14) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
