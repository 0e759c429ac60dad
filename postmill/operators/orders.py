"""Order-status routing: find the order a message asks about, pick a route, fill the template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import add_business_days, age_days, long_date
from ..functions.tags import ESCALATION_NEEDED, REVIEW_DRAFT, store_of
from ..functions.text import first_name, order_number, text_or_empty
from ..sources.scans import since_day
from .labels import has_any

WISMO_TAGS = ("US_WISMO", "LIFESTYLE_WISMO")


def wismo_queue(messages: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Unread, recent order-status messages without draft or escalation."""
    return (
        since_day(messages, as_of, days).filter(
            F.col("is_unread") & has_any(WISMO_TAGS) & ~has_any((REVIEW_DRAFT, ESCALATION_NEEDED))
        )
        .withColumn("tag", F.when(F.array_contains("labels", "US_WISMO"), "US_WISMO").otherwise("LIFESTYLE_WISMO"))
        .dropDuplicates(["message_id"])
    )


def join_orders(messages: DataFrame, orders: DataFrame, body: str = "body", tag: str = "tag") -> DataFrame:
    """Left join to the order table on (store, order number).

    ``orders`` holds one row per key. Messages without a number get a key of their own that
    matches nothing, so they stay spread out instead of meeting in one null partition.
    """
    keyed = (
        messages.withColumn("store", store_of(F.col(tag)))
        .withColumn("order_no", order_number(text_or_empty(F.col(body)), F.col(tag)))
        .withColumn("_key", F.coalesce("order_no", F.concat(F.lit("~"), F.col("message_id"))))
    )
    dim = orders.select(
        F.col("store").alias("_store"), F.col("order_no").alias("_order_no"),
        F.col("created_at").alias("order_created_at"), "fulfillment_status", "tracking_url", "carrier",
        "fulfilled_at", "shipment_status", "estimated_delivery_date", "delivered_at",
    ).withColumn("_found", F.lit(True))
    hit = (F.col("_key") == F.col("_order_no")) & (F.col("store") == F.col("_store"))
    return keyed.join(dim, hit, "left").drop("_key", "_store", "_order_no")


def route(age: Column, stuck_days: int = 3) -> Column:
    """Route of a message that was joined to orders; a missing shipment status is not 'delivered'."""
    tracked = F.col("tracking_url").isNotNull()
    delivered = F.col("shipment_status").eqNullSafe("delivered")
    return (
        F.when(F.col("order_no").isNull(), "RETRIAGE")
        .when(F.col("_found").isNull(), "ORDER_ERROR")
        .when(tracked & ~delivered, "A")
        .when(tracked, "A2")
        .when(age > stuck_days, "B")
        .otherwise("C")
    )


def route_orders(messages: DataFrame, orders: DataFrame, as_of, stuck_days: int = 3, body: str = "body") -> DataFrame:
    """Add the order's columns, ``order_age_days`` and ``route`` (A, A2, B, C, ORDER_ERROR, RETRIAGE)."""
    joined = join_orders(messages, orders, body)
    return (
        joined.withColumn("order_age_days", age_days(as_of, F.col("order_created_at")))
        .withColumn("route", route(F.col("order_age_days"), stuck_days))
        .drop("_found")
    )


def _line(*parts) -> Column:
    """One template line; it is null, and so left out, if any slot is null."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def fill_templates(routed: DataFrame, brand: str = "our shop", signer: str = "Customer Support") -> DataFrame:
    """Add ``draft_text`` for the drafted routes. Lines with an unknown slot are dropped.

    The wording is fixed; brand and signer are the caller's.
    """
    name = F.col("first_name")
    order = F.col("order_no")
    sign_off = [F.lit(""), F.lit("Warm regards,"), F.lit(signer), F.lit(f"{brand} Support")]
    greeting = [_line("Hi ", name, ","), F.lit("")]
    shipped = [
        *greeting,
        F.lit("Thank you for reaching out! Here is the latest on your order."),
        F.lit(""),
        _line("Order: ", order),
        _line("Placed: ", long_date(F.col("order_created_at"))),
        F.lit("Status: Shipped"),
        F.lit(""),
        F.lit("📦 Tracking Information"),
        _line("Your order was shipped via ", F.col("carrier"), " and can be tracked here: ", F.col("tracking_url")),
        F.lit(""),
        _line("Estimated delivery: ", long_date(F.col("estimated_delivery_date"))),
        F.lit(""),
        F.lit(
            "If your tracking has not updated in the last 48 hours or your estimated delivery date has passed, "
            "reply to this email and we will look into it right away."
        ),
        F.lit(""),
        F.lit(f"Thank you for choosing {brand}. We appreciate your patience and support."),
        *sign_off,
    ]
    processing = [
        *greeting,
        _line("Thanks for reaching out! Your order ", order, " is currently being prepared for shipment."),
        F.lit(""),
        _line("Expected ship date: ", long_date(F.col("fulfilled_at"))),
        F.lit("You will receive a tracking confirmation email as soon as it is on its way."),
        F.lit(""),
        F.lit("We appreciate your patience. Great things are worth the wait!"),
        *sign_off,
    ]
    check_by = long_date(add_business_days(F.to_date("delivered_at"), 2))
    missing = [
        *greeting,
        _line(
            "We are sorry to hear your package has not arrived! Your order ", order,
            " was marked as delivered on ", long_date(F.col("delivered_at")), ".",
        ),
        F.lit(""),
        F.lit("Here are a few quick steps to check:"),
        F.lit(""),
        F.lit("- Confirm the delivery address on your order matches your current address"),
        F.lit("- Check with neighbors or building management for any held packages"),
        F.lit("- Allow 1 to 2 business days, as carriers sometimes mark items delivered early"),
        F.lit(""),
        _line(
            "If it still has not arrived after ", check_by,
            ", reply to this email and we will open an investigation with ", F.col("carrier"), " on your behalf.",
        ),
        *sign_off,
    ]
    text = (
        F.when(F.col("route") == "A", F.concat_ws("\n", *shipped))
        .when(F.col("route") == "C", F.concat_ws("\n", *processing))
        .when(F.col("route") == "A2", F.concat_ws("\n", *missing))
    )
    if "first_name" not in routed.columns:
        routed = routed.withColumn("first_name", first_name(F.col("sender")))
    return routed.withColumn("draft_text", text)


def route_report(routed: DataFrame) -> DataFrame:
    """Counters of the order-status step per tag."""
    return routed.groupBy("tag", "route").agg(F.count(F.lit(1)).alias("n"))
