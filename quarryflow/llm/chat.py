"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A conversation's log is folded into final messages: a ``message`` event sets a message's text, a ``delta``
appends to it, an ``edit`` puts another text in its place and a ``regenerate`` empties it for what follows.
So a message is its events from the last one that set, replaced or emptied it, joined in the log's order.

Rendering marks a turn as ``### role:``, its text, and ``</turn>``. Inside texts and roles ``\\`` and ``#``
get a backslash before them and ``</`` one inside, so no control string can occur there, and dropping each
backslash for the character after it gives the text back. Role names also hide ``:`` and line ends.

One conversation's messages become one row, which is the result asked for; until that last step events are
dealt by message and running sums stream, so a long conversation is never a list in a task before then.

Defined cases: null texts and roles are empty; a null conversation is one like any other; of events with the
same place in the log the order is by kind, then text; rows that repeat a turn are each a message, ordered by
role and text; a null turn comes first; an empty log gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, NAMED, CLOSE = "### ", ":\n", "\n</turn>\n"
#: The role whose texts are trained on.
LEARNED = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("#"), F.lit("\\#")), F.lit("</"), F.lit("<\\/"))


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), "([:\n])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, place, message, role, text) of events (conv_id, seq, kind, message, role, text).

    ``place`` is the message's first place in the log. A message's role is the first that its events name.
    """
    own = Window.partitionBy("conv_id", "message")
    sets = F.when(F.col("kind").isin("message", "edit", "regenerate"), F.col("seq"))
    live = events.withColumn("_from", F.max(sets).over(own)).withColumn("place", F.min("seq").over(own))
    part = F.when(F.col("_from").isNull() | (F.col("seq") >= F.col("_from")), F.struct("seq", F.col("kind") == "delta", F.coalesce("text", F.lit("")).alias("text")))
    parts = F.array_sort(F.collect_list(part))
    text = F.array_join(F.transform(parts, lambda x: x["text"]), "")
    role = F.min_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "role")))
    return live.groupBy("conv_id", "message").agg(F.min("place").alias("place"), F.coalesce(role, F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, and loss_mask: array of (turn, start, end), the code points that are trained on."""
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(NAMED))
    rows = messages.select("conv_id", "place", "message", (F.col("role") == LEARNED).alias("learned"), head.alias("head"), escape(F.col("text")).alias("body"))
    order = Window.partitionBy("conv_id").orderBy("place", "message")
    size = F.length("head") + F.length("body") + len(CLOSE)
    at = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    begin = F.col("at") + F.length("head")
    rows = rows.withColumn("at", at).withColumn("turn", F.row_number().over(order) - 1)
    turn = F.struct("turn", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), "learned", begin.alias("start"), (begin + F.length("body")).alias("end"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    mask = F.transform(F.filter("turns", lambda x: x["learned"]), lambda x: F.struct(x["turn"].alias("turn"), x["start"].alias("start"), x["end"].alias("end")))
    return whole.select("conv_id", F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"), mask.alias("loss_mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, from ``formatted`` and ``loss_mask`` alone."""
    pieces = F.split("formatted", CLOSE, -1)
    name = lambda x: F.substring_index(F.substring(x, F.lit(len(OPEN) + 1), F.length(x)), NAMED, 1)
    body = lambda x: F.substring(x, F.length(name(x)) + len(OPEN) + len(NAMED) + 1, F.length(x))
    turn = lambda x: F.struct(unescape(name(x)).alias("role"), unescape(body(x)).alias("text"))
    out = rendered.withColumn("turns", F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn))
    return out.withColumn("loss_text", F.array_join(F.transform("loss_mask", lambda m: F.get("turns", m["turn"])["text"]), ""))


def as_events(conversations: DataFrame) -> DataFrame:
    """Rows of whole turns as a log: each row sets one message."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(*(F.col(c).cast(t) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    n = F.row_number().over(order)
    return rows.select("conv_id", n.alias("seq"), F.lit("message").alias("kind"), n.alias("message"), "role", "text")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts look like the template's own marks."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))


def op9_chat(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(probe(conversations.sparkSession))
    back = read_back(render(fold(as_events(rows))))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, x.k, case x.k when 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from (values (0), (1)) as x(k)
), e as (
  select *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/') as body from c
)
select cast(conv_id as bigint) as conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
  cast(sum(length(role) + length(body) + 15) as bigint) as formatted_chars
from e group by conv_id"""
