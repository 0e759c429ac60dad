"""Draft-against-sent scoring columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import text_or_empty

NARROW_BAND = 64


def bit_distance(a: str, b: str) -> int:
    """Levenshtein distance over code points, a whole column of the table at a time in the bits of two integers.

    The bits say where the column rises or falls from one row to the next; common ends are cut off first.
    """
    start, end = 0, 0
    most = min(len(a), len(b))
    while start < most and a[start] == b[start]:
        start += 1
    while end < most - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rises, falls, distance = every, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        kept = same | falls
        level = (((same & rises) + rises) ^ rises) | same
        up, down = falls | (every & ~(level | rises)), rises & level
        if up & last:
            distance += 1
        elif down & last:
            distance -= 1
        up, down = (up << 1 | 1) & every, down << 1 & every
        rises, falls = down | (every & ~(kept | up)), up & kept
    return distance


def far_distance(a: Column, b: Column) -> Column:
    """``bit_distance`` of the rows where neither side is null, in Arrow batches."""

    def run(lefts, rights):
        import pandas as pd

        pairs = zip(lefts.tolist(), rights.tolist(), strict=True)
        return pd.Series([None if x is None or y is None else bit_distance(x, y) for x, y in pairs], dtype="Int32")

    # the hints are set here, as names in them would be looked up in the module
    import pandas as pd

    run.__annotations__ = {"lefts": pd.Series, "rights": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "int")(a, b)


def edit_distance(draft: Column, sent: Column) -> Column:
    """Levenshtein distance over code points, exact.

    Most sent replies are the draft or nearly so. Equal texts cost nothing; then the
    banded form looks for a distance within ``NARROW_BAND``, whose cost grows with the
    band and not with the product of the lengths; only the rest pays the full price.
    """
    banded = F.levenshtein(draft, sent, NARROW_BAND)
    return F.when(draft == sent, F.lit(0)).otherwise(
        F.coalesce(F.nullif(banded, F.lit(-1)), F.levenshtein(draft, sent))
    )


def edit_pct(distance: Column, draft_length: Column) -> Column:
    """Distance per hundred draft characters; an empty draft counts as unedited."""
    return F.when(draft_length > 0, F.round(distance / draft_length * 100, 4)).otherwise(F.lit(0.0))


def accuracy_score(pct: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - pct)), 4)


def result_band(pct: Column) -> Column:
    return (
        F.when(pct == 0.0, "PERFECT").when(pct < 5.0, "MINOR_EDIT").when(pct <= 50.0, "MAJOR_EDIT").otherwise("REWRITE")
    )


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def score(pairs: DataFrame, draft_col: str = "draft_text", sent_col: str = "final_sent", by_bits: bool = False) -> DataFrame:
    """Add edit_distance, total_chars, edit_pct, accuracy_score, result and empty_draft to (draft, sent) rows.

    The same ladder as ``edit_distance``, as stacked projections, so that each step runs once. ``by_bits`` sends the far
    pairs to Python, which is meant for logs in which many replies were rewritten.
    """
    draft, sent = text_or_empty(F.col(draft_col)), text_or_empty(F.col(sent_col))
    far = F.col("_near") < 0
    if by_bits:
        full = F.coalesce(F.when(~far, F.col("_near")), far_distance(F.when(far, draft), F.when(far, sent)))
    else:
        full = F.when(far, F.levenshtein(draft, sent)).otherwise(F.col("_near"))
    return (
        pairs.withColumn("total_chars", F.length(draft))
        .withColumn("_near", F.when(draft == sent, F.lit(0)).otherwise(F.levenshtein(draft, sent, NARROW_BAND)))
        .withColumn("edit_distance", full)
        .withColumn("edit_pct", edit_pct(F.col("edit_distance"), F.col("total_chars")))
        .withColumn("accuracy_score", accuracy_score(F.col("edit_pct")))
        .withColumn("result", result_band(F.col("edit_pct")))
        .withColumn("empty_draft", F.col("total_chars") == 0)
        .drop("_near")
    )
