"""Per-thread context: last messages, contact numbers, earlier commitments.

A thread may hold a large share of all messages. Last-n ranks are limited on the map
side, "was there one before" is a minimum written and joined back, and running numbers are counted
per time slot, with the slots' offsets added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import spread_join

ORDER = ("received_at", "message_id")


def in_thread(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("thread_id") != "")


def thread_context(messages: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` messages of each thread, oldest first, as an array of structs."""
    newest = Window.partitionBy("thread_id").orderBy(*[F.desc(c) for c in ORDER])
    recent = in_thread(messages).withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n)
    return recent.groupBy("thread_id").agg(
        F.sort_array(F.collect_list(F.struct("received_at", "message_id", "sender", "body"))).alias("context")
    )


def last_sender(messages: DataFrame) -> DataFrame:
    newest = Window.partitionBy("thread_id").orderBy(*[F.desc(c) for c in ORDER])
    return (
        in_thread(messages).withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") == 1)
        .select("thread_id", F.col("sender").alias("last_sender"))
    )


def thread_sizes(messages: DataFrame, counted: Column) -> DataFrame:
    """Contacts per thread: how many of its messages satisfy ``counted``."""
    return in_thread(messages).groupBy("thread_id").agg(F.count_if(counted).alias("contacts"))


def contact_index(messages: DataFrame, is_customer: Column, slot: str = "hour") -> DataFrame:
    """Number the customer messages of each thread in time order (1 = first contact).

    Rows are ranked within (thread, slot); the counts of earlier slots are added. Only the
    slot counts, whose number is bounded by the time covered, meet in one group.
    """
    slotted = in_thread(messages).filter(is_customer).withColumn("_slot", F.date_trunc(slot, "received_at"))
    before = Window.partitionBy("thread_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slotted.groupBy("thread_id", "_slot").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    within = Window.partitionBy("thread_id", "_slot").orderBy(*ORDER)
    return (
        slotted.withColumn("_rank", F.row_number().over(within))
        .join(offsets, ["thread_id", "_slot"])
        .withColumn("contact_no", F.col("_offset") + F.col("_rank"))
        .drop("_slot", "_rank", "_offset")
    )


def prior_commitment(messages: DataFrame, commits: Column) -> DataFrame:
    """Add ``prior_commitment``: an earlier message of the thread satisfies ``commits``."""
    first = (
        in_thread(messages).filter(commits).groupBy("thread_id")
        .agg(F.min(F.struct(*ORDER)).alias("_first"))
    )
    return (
        spread_join(messages, first, "thread_id")
        .withColumn("prior_commitment", F.coalesce(F.col("_first") < F.struct(*ORDER), F.lit(False)))
        .drop("_first")
    )


def without_prior(queue: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages that open their thread: nothing in ``messages`` precedes them."""
    first = in_thread(messages).groupBy("thread_id").agg(F.min(F.struct(*ORDER)).alias("_first"))
    later = spread_join(queue, first, "thread_id", "inner").filter(F.col("_first") < F.struct(*ORDER)).select("message_id")
    return queue.join(later, "message_id", "left_anti")
