"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its own
text is trainable. Turns after the last assistant turn, and conversations without one, end in
an example without a trainable part, so the whole conversation can be read back. A turn is
written as START role newline text STOP. In roles and texts the escape character and the first character of any control
string are escaped, and in roles the newline too, so control strings in the input can't be taken for turns
and unescaping returns the input.

An example holds its whole prefix, as the method says, so output grows with the square of a conversation's turns; the
longest example equals the conversation, which is the most that one row or task holds.

Behaviour: a null text or role is the empty one. Turns are ordered by (turn, role, text), null turns first;
repeated rows are turns of their own. Rows of a null conv_id form one conversation. Columns other than the four are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table, written
from .registry import query

START, STOP = "<s>", "</s>"
INST, END_INST = "[INST]", "[/INST]"  # not written here, but escaped, as readers of other templates act on them
TARGET = "assistant"


def escaped(text: Column) -> Column:
    r"""\ becomes \e, and the first character of a control string \l or \b; every \ is then followed by one of these letters."""
    text = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for control, mark in ((START, "\\l"), (STOP, "\\l"), (INST, "\\b"), (END_INST, "\\b")):
        text = F.replace(text, F.lit(control), F.lit(mark + control[1:]))
    return text


def unescaped(text: Column) -> Column:
    for mark, plain in (("\\n", "\n"), ("\\l", "<"), ("\\b", "["), ("\\e", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, text, loss_start, loss_chars); loss_start counts code points from 0, null without a trainable part."""
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    turns = conversations.select("conv_id", F.struct(
        F.col("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("raw"), head.alias("head"), escaped(F.coalesce("text", F.lit(""))).alias("body"),
    ).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # an example ends at every assistant turn and at the last turn
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda k: (F.get("turns", k - 1)["role"] == TARGET) | (k == F.size("turns")))
    cut = turns.select("conv_id", "turns", F.posexplode(ends).alias("example", "n_turns"))
    parts = F.transform(F.slice("turns", 1, F.col("n_turns") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(STOP)))
    last = F.get("turns", F.col("n_turns") - 1)
    made = cut.select("conv_id", "example", "n_turns", F.array_join(parts, "").alias("before"), last.alias("last"))
    target = F.col("last.role") == TARGET
    return made.select(
        "conv_id", "example", "n_turns", F.concat("before", "last.head", "last.body", F.lit(STOP)).alias("text"),
        F.when(target, F.length("before") + F.length("last.head")).alias("loss_start"),
        F.when(target, F.length("last.body")).otherwise(0).alias("loss_chars"),
    )


def parsed(text: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    pieces = F.slice(F.split(text, STOP), 1, F.size(F.split(text, STOP)) - 1)  # what follows the last STOP is empty
    return F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring_index(p.substr(F.lit(len(START) + 1), F.length(p)), "\n", 1)).alias("role"),
        unescaped(p.substr(F.locate("\n", p) + 1, F.length(p))).alias("text"),
    ))


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, turns, replies, formatted_chars) as the written examples say it."""
    return examples.groupBy("conv_id").agg(
        F.max(F.struct("example", "text"))["text"].alias("_longest"),
        F.sort_array(F.collect_list(F.when(
            F.col("loss_start").isNotNull(), F.struct("example", unescaped(F.col("text").substr(F.col("loss_start") + 1, F.col("loss_chars"))).alias("reply"))
        ))).alias("_replies"),
        F.sum(F.length("text")).alias("formatted_chars"),
    ).select("conv_id", parsed(F.col("_longest")).alias("turns"), F.transform("_replies", lambda r: r["reply"]).alias("replies"), "formatted_chars")


def extra_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")


_ESCAPED = r"""replace(replace(replace(replace(replace({0}, '\', '\e'), '<s>', '\ls>'), '</s>', '\l/s>'), '[INST]', '\bINST]'), '[/INST]', '\b/INST]')"""
OP5_SQL = """
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (
  select *, row_number() over w as k, count(*) over (partition by conv_id) as n,
    sum(7 + 1 + length(replace(ER, chr(10), '\\n')) + length(ET)) over (partition by conv_id order by turn nulls first, role, text rows unbounded preceding) as upto
  from c window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(upto) filter (role = 'assistant' or k = n) as bigint) as formatted_chars
from t group by conv_id
""".replace("ER", _ESCAPED.format("role")).replace("ET", _ESCAPED.format("text"))


@query(OP5_SQL)
def op5_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    back = read_back(written(expand(given.unionByName(extra_conversation(spark))), "chat"))
    replies = F.array_join("replies", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(replies).cast("long").alias("loss_chars"), F.sha2(replies, 256).alias("loss_sha256"), "formatted_chars",
    )
