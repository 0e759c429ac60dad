"""Plain text of MIME payloads given as JSON strings."""

from __future__ import annotations

import base64
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

#: Levels of parts that are read natively.
LEVELS = 4
_NODE = "mimeType:string, body:struct<data:string>"


def _parts(levels: int) -> str:
    """The type of a list of parts; below the last level only the number of parts is known."""
    return f"array<struct<{_NODE}, parts:{_parts(levels - 1)}>>" if levels else "array<struct<mimeType:string>>"


TREE = f"struct<{_NODE}, parts:{_parts(LEVELS)}>"


def decode_base64url(data: Column) -> Column:
    """URL-safe base64 with or without padding; bytes that are no UTF-8 become replacement signs."""
    plain = F.rtrim(F.translate(data, "-_", "+/"), F.lit("="))
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
    return F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))


def _decode(data: str) -> str:
    return base64.urlsafe_b64decode(data + "=" * (-len(data) % 4)).decode("utf-8", errors="replace")


def _first_text(node: dict) -> str:
    """First plain-text part of a level, else the first non-empty text further down."""
    parts = node.get("parts") or []
    if not parts:
        data = (node.get("body") or {}).get("data") or ""
        return _decode(data.rstrip("=")) if data else ""
    for part in parts:
        data = (part.get("body") or {}).get("data") or ""
        if part.get("mimeType") == "text/plain" and data:
            return _decode(data.rstrip("="))
    return next((text for text in map(_first_text, parts) if text), "")


@F.pandas_udf(StringType())
def _nested_text(payload: pd.Series) -> pd.Series:
    return payload.map(lambda p: None if p is None else _first_text(json.loads(p)))


def _data(node: Column, levels: int) -> Column:
    """What ``_first_text`` decodes, found in a parsed tree."""
    own = F.coalesce(node["body"]["data"], F.lit(""))
    if not levels:
        return F.rtrim(own, F.lit("="))
    parts = node["parts"]
    plain = F.filter(parts, lambda p: (p["mimeType"] == "text/plain") & (F.coalesce(p["body"]["data"], F.lit("")) != ""))
    below = F.filter(F.transform(parts, lambda p: _data(p, levels - 1)), lambda data: data != "")
    found = F.coalesce(F.try_element_at(plain, F.lit(1))["body"]["data"], F.try_element_at(below, F.lit(1)), F.lit(""))
    return F.rtrim(F.when(F.size(F.coalesce(parts, F.array())) == 0, own).otherwise(found), F.lit("="))


def _goes_on(node: Column, levels: int) -> Column:
    """Whether a tree has parts below the levels that were read."""
    parts = node["parts"]
    return F.coalesce(F.exists(parts, lambda p: _goes_on(p, levels - 1)) if levels else F.size(parts) > 0, F.lit(False))


def with_mime_body(df: DataFrame, payload_col: str, out_col: str = "body") -> DataFrame:
    """Add the message text of a MIME tree.

    Trees of up to ``LEVELS`` levels of parts, nearly all mail, are read natively, a row at a time. Only payloads nested deeper,
    and those below whose first level the data is no strict base64, are sent to Python, as nulls stand for the others.
    """
    tree = F.col("_tree")
    staged = df.withColumn("_tree", F.from_json(F.col(payload_col), TREE))
    nested = F.size(F.coalesce(tree["parts"], F.array())) > 0
    staged = staged.select("*", _data(tree, LEVELS).alias("_data"), nested.alias("_nested"), _goes_on(tree, LEVELS).alias("_more"))
    staged = staged.drop("_tree").withColumn("_text", decode_base64url(F.col("_data")))
    left = F.col("_more") | (F.col("_nested") & F.col("_text").isNull())
    return (
        staged.withColumn("_deep", _nested_text(F.when(left, F.col(payload_col))))
        .withColumn(out_col, F.coalesce(F.when(~F.col("_more"), F.col("_text")), F.col("_deep"), F.lit("")))
        .drop("_data", "_nested", "_more", "_text", "_deep")
    )
