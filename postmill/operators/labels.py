"""Label states: which messages to process, draft, skip, correct or clean up.

Labels are a set of strings per message; every transition is an array function on that
column. Conditions on other messages of a thread come from aggregates joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rule_words as W
from ..functions.tags import (
    AI_PROCESSED, B2B, CHARGEBACKS, CLASSIFICATION, DRAFTABLE, ESCALATION_NEEDED, REVIEW_DRAFT, tag_array,
)
from ..functions.text import contains_any, text_or_empty
from ..session import spread_join
from ..sources.scans import since_day

LABELS = "labels"


def has_label(name: str, labels: str = LABELS) -> Column:
    return F.array_contains(F.col(labels), name)


def has_any(names, labels: str = LABELS) -> Column:
    return F.arrays_overlap(F.col(labels), tag_array(names))


def add_labels(labels: Column, *names) -> Column:
    return F.array_union(labels, tag_array(names))


def remove_labels(labels: Column, names) -> Column:
    return F.array_except(labels, tag_array(names))


def processing_state(messages: DataFrame) -> DataFrame:
    """Add ``state``: skip, rerun or new.

    A processed, untagged and read message is skipped; a tag without the processed mark
    counts as new.
    """
    done, tagged = has_label(AI_PROCESSED), has_any(CLASSIFICATION)
    return messages.withColumn(
        "state",
        F.when(~done, "new").when(tagged, "skip").when(F.col("is_unread"), "rerun").otherwise("skip"),
    )


def _open_queue(messages: DataFrame, as_of, days: int) -> DataFrame:
    return since_day(messages, as_of, days).filter(
        F.col("is_unread")
        & has_label(AI_PROCESSED)
        & ~has_any((REVIEW_DRAFT, B2B, *CHARGEBACKS))
    )


def eligible_classified(messages: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Search A: processed, unread, recent, no draft yet, and carrying a draftable tag."""
    return _open_queue(messages, as_of, days).filter(has_any(DRAFTABLE))


def eligible_replies(messages: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Search B: the same queue without any draftable tag."""
    return _open_queue(messages, as_of, days).filter(~has_any(DRAFTABLE))


def eligible(messages: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Both searches with their ``search`` letter. They exclude each other, so one scan serves both;
    messages fetched twice are kept once."""
    return (
        _open_queue(messages, as_of, days)
        .withColumn("search", F.when(has_any(DRAFTABLE), "A").otherwise("B"))
        .dropDuplicates(["message_id"])
    )


def merge_searches(*searches: DataFrame) -> DataFrame:
    """Union of searches, each message once."""
    merged = searches[0]
    for other in searches[1:]:
        merged = merged.unionByName(other)
    return merged.dropDuplicates(["message_id"])


def first_in_thread(thread_messages: DataFrame) -> DataFrame:
    """The first (received_at, message_id) of each thread; partial aggregates keep hot threads small."""
    return (
        thread_messages.filter(F.col("thread_id") != "")
        .groupBy("thread_id")
        .agg(F.min(F.struct("received_at", "message_id")).alias("_first"))
    )


def preflight(queue: DataFrame, thread_messages: DataFrame) -> DataFrame:
    """Add ``outcome`` to eligible messages, first match wins: RETRIAGE, SKIP, MISLABELED, PROCEED.

    The form sender is exempt before the machine-sender test.
    """
    sender = F.col("_sender")
    machine = contains_any(sender, W.MACHINE_SENDERS + W.B2B_DOMAINS + W.B2B_ADDRESSES)
    has_prior = F.coalesce(F.col("_first") < F.struct("received_at", "message_id"), F.lit(False))
    return (
        spread_join(queue, first_in_thread(thread_messages), "thread_id")
        .withColumn("_sender", F.lower(text_or_empty(F.col("sender"))))
        .withColumn(
            "outcome",
            F.when((F.col("search") == "B") & ~has_prior, "RETRIAGE")
            .when(sender.contains(W.FORM_SENDER), "SKIP")
            .when(machine, "MISLABELED")
            .otherwise("PROCEED"),
        )
        .drop("_first", "_sender")
    )


def correct_mislabeled(checked: DataFrame) -> DataFrame:
    """Mislabeled messages lose their tags and gain the bulk tag; the processed mark stays."""
    fixed = F.array_union(remove_labels(F.col(LABELS), CLASSIFICATION), tag_array([B2B]))
    return checked.withColumn(LABELS, F.when(F.col("outcome") == "MISLABELED", fixed).otherwise(F.col(LABELS)))


def apply_classification(classified: DataFrame) -> DataFrame:
    """Add the tag and the processed mark to the rows that got a tag."""
    return classified.withColumn(
        LABELS,
        F.when(
            F.col("tag").isNotNull(),
            F.array_union(F.col(LABELS), F.array(F.col("tag"), F.lit(AI_PROCESSED))),
        ).otherwise(F.col(LABELS)),
    )


def mark_drafted(messages: DataFrame) -> DataFrame:
    """After a draft is written: add the review mark, keep the tag and the unread state."""
    return messages.withColumn(LABELS, add_labels(F.col(LABELS), REVIEW_DRAFT))


def mark_routed(routed: DataFrame) -> DataFrame:
    """Order-status outcomes: stuck orders escalate, drafted routes go to review, the rest stay."""
    return routed.withColumn(
        LABELS,
        F.when(F.col("route") == "B", add_labels(F.col(LABELS), ESCALATION_NEEDED))
        .when(F.col("route").isin("A", "A2", "C"), add_labels(F.col(LABELS), REVIEW_DRAFT))
        .otherwise(F.col(LABELS)),
    )


def cleanup(messages: DataFrame, agent: str, thread_messages: DataFrame | None = None) -> DataFrame:
    """Review marks that are settled, with ``cleanup`` = replied, read or pending.

    A thread is settled when the agent has written in it, or when the message was read.
    """
    source = messages if thread_messages is None else thread_messages
    answered = (
        source.filter(F.lower(F.col("sender")).contains(agent.lower()) & (F.col("thread_id") != ""))
        .select("thread_id").distinct().withColumn("_answered", F.lit(True))
    )
    marked = messages.filter(has_label(REVIEW_DRAFT))
    return (
        spread_join(marked, answered, "thread_id")
        .withColumn(
            "cleanup", F.when(F.col("_answered"), "replied").when(~F.col("is_unread"), "read").otherwise("pending")
        )
        .withColumn(
            LABELS,
            F.when(F.col("cleanup") == "pending", F.col(LABELS))
            .otherwise(F.array_remove(F.col(LABELS), REVIEW_DRAFT)),
        )
        .drop("_answered")
    )


def threads_with_agent(thread_messages: DataFrame, agent: str) -> DataFrame:
    """Messages of threads in which the agent has written, by semi-join; a blank thread id is no thread."""
    known = thread_messages.filter(F.col("thread_id") != "")
    answered = known.filter(F.lower(F.col("sender")).contains(agent.lower())).select("thread_id").distinct()
    return spread_join(known, answered, "thread_id", "left_semi")


def attended_by_last_sender(thread_messages: DataFrame, agent: str) -> DataFrame:
    """Earlier cleanup rule: a thread is attended when the agent wrote its last message."""
    last = F.max_by("sender", F.struct("received_at", "message_id"))
    return (
        thread_messages.filter(F.col("thread_id") != "")
        .groupBy("thread_id")
        .agg(last.alias("last_sender"))
        .withColumn("attended", F.lower(F.col("last_sender")).contains(agent.lower()))
    )


def label_batches(classified: DataFrame, size: int = 1000) -> DataFrame:
    """Message ids per tag in batches of at most ``size``, one bulk label call each.

    Batches are cut within a (tag, hour of arrival), so a tag that holds most messages
    is still numbered by many tasks.
    """
    slot = F.date_trunc("hour", "received_at")
    keyed = classified.filter(F.col("tag").isNotNull()).select("tag", slot.alias("slot"), "message_id")
    order = Window.partitionBy("tag", "slot").orderBy("message_id")
    batch = F.floor((F.row_number().over(order) - 1) / size)
    return (
        keyed.withColumn("batch", batch)
        .groupBy("tag", "slot", "batch")
        .agg(F.sort_array(F.collect_list("message_id")).alias("message_ids"))
    )


def only_if_category(messages: DataFrame, upstream: DataFrame, tags) -> DataFrame:
    """Pass ``messages`` on only if ``upstream`` holds one of the tags; otherwise nothing.

    The existence test is a one-row scalar subquery, not a join.
    """
    found = upstream.filter(F.col("tag").isin(*tags)).limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
    return messages.filter(found > 0)


def step_report(outcomes: DataFrame, step: str, outcome_col: str = "outcome") -> DataFrame:
    """Counters of one step as (step, outcome, n)."""
    return (
        outcomes.groupBy(F.lit(step).alias("step"), F.col(outcome_col).alias("outcome"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def step_summary(outcomes: DataFrame, names, outcome_col: str = "outcome") -> DataFrame:
    """The same counters as one row with a column per outcome."""
    return outcomes.agg(*[F.count_if(F.col(outcome_col) == n).alias(n.lower()) for n in names])
