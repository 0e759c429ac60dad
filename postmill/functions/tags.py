"""The tag taxonomy and the state labels.

Tags are written without a site prefix. A mailbox whose labels carry one is read with
``without_prefix`` and written with ``with_prefix``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
STORES = ("US", "LIFESTYLE")
ISSUES = ("WISMO", "WARRANTY", "RETURN", "SHIPPING", "OOS", "ADDRESS", "ORDERMOD", "GENERAL")
CHARGEBACKS = ("US_CHARGEBACK", "LIFESTYLE_CHARGEBACK")
PRODUCT_TAGS = ("GENERAL_PRODUCT", "GENERAL_COMPATIBILITY", "GENERAL_PREORDER")
B2B = "B2B_FILTERED"
AI_PROCESSED = "AI_PROCESSED"
REVIEW_DRAFT = "REVIEW_DRAFT"
ESCALATION_NEEDED = "ESCALATION_NEEDED"

DRAFTABLE = tuple(f"{s}_{i}" for s in STORES for i in ISSUES) + PRODUCT_TAGS
CLASSIFICATION = DRAFTABLE + CHARGEBACKS + (B2B,)


def tag_array(tags) -> Column:
    return F.array(*[F.lit(t) for t in tags])


def store_of(tag: Column, us: str = "us", lifestyle: str = "lifestyle") -> Column:
    """The shop a tag belongs to; none for the tags without an order."""
    return F.when(tag.startswith("US_"), F.lit(us)).when(tag.startswith("LIFESTYLE_"), F.lit(lifestyle))


def with_prefix(tag: Column, prefix: str) -> Column:
    return F.when(tag.rlike("^(US|LIFESTYLE)_"), F.concat(F.lit(prefix), tag)).otherwise(tag)


def without_prefix(tag: Column, prefix: str) -> Column:
    return F.when(tag.startswith(prefix), F.substring(tag, len(prefix) + 1, 1 << 30)).otherwise(tag)
