"""Chat formatting by prefix-target expansion (DataFrame functions only).

Template, one per turn::

    ### Assistant: text</turn>\\n

``\\``, ``### `` and ``</turn>`` inside a role or text get a ``\\`` in front, so
an unescaped marker is always a real one and the text comes back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

# The labels of the usual roles; any other role is written as "=role".
ROLE_LABELS = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
OPEN, CLOSE, END = "### ", "</turn>", "</turn>\n"
# One formatted turn: header up to the first unescaped ": ", then text up to
# the first unescaped end marker. Possessive loops: no backtracking, no stack.
TURN = r"(?s)### ((?:[^\\:]|\\.|:(?! ))*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(OPEN), F.lit("\\" + OPEN))
    return F.replace(out, F.lit(CLOSE), F.lit("\\" + CLOSE))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\|### |</turn>|: )", "$1")


def role_label(role: Column) -> Column:
    out = F.concat(F.lit("="), F.replace(escape(role), F.lit(": "), F.lit("\\: ")))
    for raw, label in ROLE_LABELS.items():
        out = F.when(role == raw, F.lit(label)).otherwise(out)
    return out


def role_of(label: Column) -> Column:
    out = unescape(F.substr(label, F.lit(2)))
    for raw, name in ROLE_LABELS.items():
        out = F.when(label == name, F.lit(raw)).otherwise(out)
    return out


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted`` (all turns in order) and
    ``examples``, an array with one entry per assistant turn: its number, the
    number of turns before it, the code points of context before its reply,
    the loss span [loss_start, loss_end) in code points of ``formatted`` and
    the escaped ``reply`` under that span.

    Turns are ordered by (turn, role, text), null turns first; repeated rows
    stay repeated turns. Null role and text count as empty; rows with a null
    conv_id form one conversation with a null id. A conversation without an
    assistant turn has an empty ``examples`` array. Other columns are ignored.
    An empty table gives no rows. A conversation is one row here, as its digest
    is one sequential hash: it must fit a Java string (2 GB).
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("conv_id", "turn", "role", "text",
                       F.concat(F.lit(OPEN), role_label(F.col("role")), F.lit(": ")).alias("head"),
                       escape(F.col("text")).alias("body"))
    # where each turn starts: a running sum over the rows, which are dealt by conversation only once
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    rows = rows.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("int"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "turn", "role", "text", "start", "head", "body"))).alias("ts"))
    spans = F.transform("ts", lambda t, i: F.struct(
        i.alias("context_turns"), t["role"].alias("role"),
        (t["start"] + F.length(t["head"])).alias("loss_start"), t["body"].alias("reply")))
    replies = F.filter(spans, lambda s: s["role"] == "assistant")
    examples = F.transform(replies, lambda s, i: F.struct(
        i.alias("example"), s["context_turns"].alias("context_turns"), s["loss_start"].alias("loss_start"),
        (s["loss_start"] + F.length(s["reply"])).alias("loss_end"), s["reply"].alias("reply")))
    return convs.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        examples.alias("examples"))


def prefix_targets(formatted: DataFrame, *keep: str, all_rows: bool = False) -> DataFrame:
    """Every assistant turn as its own training example: ``text`` is the
    formatted conversation up to and including that reply, ``prompt_chars`` its
    part without loss, and only [loss_start, loss_end) is trainable. ``text``
    of one conversation grows with the square of its turns; readers that need
    spans only leave the column out, and Spark then never builds it. ``keep``
    names further columns to carry along; with ``all_rows`` a conversation
    without a reply has one row without an example."""
    explode = F.explode_outer if all_rows else F.explode
    rows = formatted.select("conv_id", "formatted", *keep, explode("examples").alias("e"))
    return rows.select(
        "conv_id", *keep, F.col("e.example").alias("example"), F.col("e.context_turns").alias("context_turns"),
        F.col("e.loss_start").alias("loss_start"), F.col("e.loss_end").alias("loss_end"),
        F.concat(F.substr(F.col("formatted"), F.lit(1), F.col("e.loss_end")), F.lit(END)).alias("text"),
        F.col("e.reply").alias("reply"))


def digests(formatted: DataFrame) -> DataFrame:
    """Read the output back: turns parsed from ``formatted``, loss text cut by
    its span out of the text of every expanded example."""
    turns = F.transform(F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0)), lambda s: F.struct(
        role_of(F.regexp_extract(s, TURN, 1)).alias("role"), unescape(F.regexp_extract(s, TURN, 2)).alias("text")))
    read = formatted.select("conv_id", "formatted", turns.alias("turns"), "examples")
    read = read.select(
        "conv_id", "formatted", F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
               256).alias("turns_sha256"), "examples")
    whole = ["n_turns", "turns_sha256", "formatted_chars"]
    cut = prefix_targets(read, *whole, all_rows=True).select("conv_id", *whole, "example", unescape(
        F.substr(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))).alias("loss"))
    # grouped by the key the rows are already dealt by: no further shuffle
    out = cut.groupBy("conv_id", *whole).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda e: e["loss"]), "")
        .alias("loss"), F.count("example").alias("n_examples"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
                      F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")


PROBE = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(PROBE).alias("text"))
    return digests(format_conversations(conversations.unionByName(probe)))


ORACLE = r"""
WITH rows_ AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role,
         coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') AS body,
         replace(replace(replace(role, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') AS erole FROM rows_)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), ''))
         AS loss_sha256,
       CAST(sum(4 + CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 WHEN 'system' THEN 6 WHEN 'tool' THEN 4
                    ELSE 1 + length(replace(erole, ': ', '\: ')) END + 2 + length(body) + 8) AS BIGINT)
         AS formatted_chars,
       count(*) FILTER (role = 'assistant') AS n_examples
FROM e GROUP BY conv_id
"""
