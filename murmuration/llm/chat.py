"""Chat formatting from event logs, with DataFrame functions only.

A log row is (conv_id, seq, msg, kind, role, text). Kinds: `message` opens message msg, `delta`
appends to it, `edit` replaces its text, `regenerate` empties it so that later deltas start anew.
The log is folded by message, then by conversation in order of the messages' first events, then
rendered. A message's text is what follows its last `message`, `edit` or `regenerate` event, so the
fold is a filter on a window maximum and an ordered concatenation, not a sequential loop.

Template: `### ` role, newline, text, `</turn>`, newline. Inside roles and texts `\\`, `<`, `#` (and,
in roles, the newline) become `\\b`, `\\l`, `\\h`, `\\n`: no control string can occur in a text, and
`unescape` restores it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

OPEN, CLOSE = "### ", "</turn>\n"
#: Messages are joined in runs of so many before the conversation is put together.
RUN = 256


def _replace(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column) -> Column:
    return _replace(c, [("\\", "\\b"), ("<", "\\l"), ("#", "\\h")])


def unescape(c: Column) -> Column:
    return _replace(c, [("\\n", "\n"), ("\\h", "#"), ("\\l", "<"), ("\\b", "\\")])


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def fold(log: DataFrame) -> DataFrame:
    """The final messages of a log: conv_id, at (seq of the first event), msg, role, text.

    Null text counts as empty, a null or missing role as ''. Events of equal seq are taken in the order
    message, edit, regenerate, delta, then by text. Deltas of a message that was never opened belong to
    one opened by the first of them. Kinds that are not known are ignored, and so are other columns; texts of
    any length are taken whole; an empty log gives no messages. seq may be of any type that can be ordered.
    """
    kind = F.array_position(F.array(*map(F.lit, ["message", "edit", "regenerate", "delta"])), F.coalesce("kind", F.lit("")))
    e = log.select("conv_id", "msg", "role", F.struct("seq", kind.alias("kind")).alias("at"), F.coalesce("text", F.lit("")).alias("text")).filter("at.kind > 0")
    own = W.partitionBy("conv_id", "msg")
    reset = F.coalesce(F.max(F.when(F.col("at.kind") < 4, F.col("at"))).over(own), F.min("at").over(own))
    live = (F.col("at") >= F.col("reset")) & (F.col("at.kind") != 3)
    e = e.withColumn("reset", reset)
    parts = F.array_sort(F.collect_list(F.when(live, F.struct("at", "text"))))
    text = F.array_join(F.transform(parts, lambda x: x["text"]), "")
    role = F.min(F.when(F.col("role").isNotNull(), F.struct("at", "role")))["role"]
    return e.groupBy("conv_id", "msg").agg(F.min("at.seq").alias("at"), F.coalesce(role, F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """messages (conv_id, at, msg, role, text): one row per conversation: conv_id, formatted, mask.

    Messages of equal `at` are ordered by role, text, msg. mask lists the spans (start from 1, len, in
    code points of formatted) of assistant texts. Runs of messages are joined first, so that a very long
    conversation reaches the last step as few rows; its text is one value, so one conversation has to fit a task
    (2 GB at most). Null conv_ids form one conversation. Other columns are ignored; no rows give no rows.
    """
    text = escape(F.col("text"))
    line = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    m = messages.select("conv_id", F.struct("at", "role", "text", "msg").alias("k"), F.concat(line, text, F.lit(CLOSE)).alias("piece"), F.char_length(line).alias("head"), F.char_length(text).alias("body"), (F.col("role") == "assistant").alias("loss"))
    by = W.partitionBy("conv_id").orderBy("k")
    # running totals place every span by itself; nothing is folded through the conversation
    before = F.coalesce(F.sum(F.col("head") + F.col("body") + len(CLOSE)).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    span = F.struct((before + F.col("head") + 1).cast("int").alias("start"), F.col("body").alias("len"))
    m = m.select("conv_id", F.struct((F.row_number().over(by) - 1).alias("n"), "piece", "loss", span.alias("span")).alias("m"))
    chunk = m.groupBy("conv_id", F.floor(F.col("m.n") / RUN).alias("run")).agg(F.array_sort(F.collect_list("m")).alias("ms"))
    whole = F.array_join(F.transform("ms", lambda x: x["piece"]), "")
    spans = F.transform(F.filter("ms", lambda x: x["loss"]), lambda x: x["span"])
    chunk = chunk.select("conv_id", F.struct("run", whole.alias("text"), spans.alias("spans")).alias("c"))
    conv = chunk.groupBy("conv_id").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    return conv.select("conv_id", F.array_join(F.transform("cs", lambda c: c["text"]), "").alias("formatted"), F.flatten(F.transform("cs", lambda c: c["spans"])).alias("mask"))


def parse(formatted: DataFrame) -> DataFrame:
    """Reads rendered text back: adds turns (array of role, text) and loss_text, the unescaped text under the mask."""
    lines = F.split(F.col("formatted"), "</turn>\n")
    lines = F.slice(lines, F.lit(1), F.size(lines) - 1)

    def turn(x: Column) -> Column:
        body = F.substring(x, F.lit(len(OPEN) + 1), F.length(x))
        return F.struct(unescape(F.substring_index(body, "\n", 1)).alias("role"), unescape(F.substring(body, F.instr(body, F.lit("\n")) + 1, F.length(body))).alias("text"))

    loss = F.transform("mask", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["len"])))
    return formatted.select("*", F.transform(lines, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"))


#: A conversation that quotes the template's own control strings.
PROBE = "\\### Assistant: </turn> ok"


def event_log(rows: DataFrame) -> DataFrame:
    """The log that leaves rows (conv_id, turn, role, text) behind, as a chat service writes it: an assistant's text is
    regenerated after a first draft and streamed in deltas, a user's is edited after a first version, any
    other is streamed behind its opening. A row without a turn is one `message`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    third = F.ceil(F.char_length(text) / 3).cast("int")
    part = [F.substring(text, F.lit(1), third), F.substring(text, third + 1, third), F.substring(text, 2 * third + 1, third)]
    event = lambda j, kind, t: F.struct(F.lit(j).alias("j"), F.lit(kind).alias("kind"), t.alias("text"))
    first = F.concat(F.lit("draft: "), F.substring(text, 1, 16))
    streamed = [event(j, "delta", p) for j, p in enumerate(part)]
    events = (
        F.when(F.col("turn").isNull(), F.array(event(0, "message", text)))
        .when(F.col("role") == "assistant", F.array(event(0, "message", first), event(1, "delta", F.lit(" (superseded)")), event(2, "regenerate", F.lit(None).cast("string")), *[event(j + 3, "delta", p) for j, p in enumerate(part)]))
        .when(F.col("role") == "user", F.array(event(0, "message", first), event(1, "edit", text)))
        .otherwise(F.array(event(0, "message", part[0]), *streamed[1:]))
    )
    # numbered before a row becomes several events
    rows = rows.select("conv_id", "turn", F.monotonically_increasing_id().alias("msg"), "role", events.alias("events"))
    log = rows.select("conv_id", "turn", "msg", "role", F.explode("events").alias("e"))
    return log.select("conv_id", F.struct("turn", "e.j").alias("seq"), "msg", "e.kind", "role", "e.text")


def op4_chat(spark, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.lit(-7).cast(c.schema["conv_id"].dataType).alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast(c.schema["turn"].dataType).alias("turn"), F.lit(r).alias("role"), F.lit(PROBE).alias("text")) for i, r in enumerate(["user", "assistant"])])).alias("t")).select("conv_id", "t.*")
    log = event_log(c.unionByName(probe))
    out = parse(render(fold(log)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', '')) AS body FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(role) + 1 + body + 8)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
