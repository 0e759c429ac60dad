"""Rule classification: a first-match cascade as one CASE over lower-cased columns.

Both forms are narrow projections: no shuffle, no Python. ``prefilter`` separates bulk
mail from what needs a closer look, ``triage`` also resolves the senders with their own
sub-rules and the order-status questions.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rule_words as W
from ..functions.tags import B2B, CLASSIFICATION
from ..functions.text import (
    ANY_ORDER,
    INTL_ORDER,
    US_ORDER,
    contains_any,
    has_cjk,
    starts_with_any,
    strip_quoted,
    text_or_empty,
)

# Rules whose hit alone means bulk mail.
BULK_RULES = ("R0.1", "R1a", "R1b", "R1", "R1.5", "R2", "R3")


FIELD_COLUMNS = ("_sender", "_subject", "_raw_subject", "_body", "_raw_body", "_content", "_unquoted")


class _Fields:
    """The inputs of the cascade, each computed once per message by ``add``."""

    def __init__(self, scan: str, body_chars: int | None):
        if scan not in ("content", "body"):
            raise ValueError("scan must be 'content' or 'body'")
        self.scan, self.body_chars = scan, body_chars
        self.sender, self.subject, self.raw_subject, self.body, self.raw_body, self.content, self.unquoted = (
            F.col(c) for c in FIELD_COLUMNS
        )

    def add(self, messages: DataFrame) -> DataFrame:
        """Append the fields; later stages read them as columns instead of repeating the expressions."""
        body = text_or_empty(F.col("body"))
        if self.body_chars is not None:
            body = F.left(body, F.lit(self.body_chars))
        lowered = messages.select(
            "*",
            F.lower(text_or_empty(F.col("sender"))).alias("_sender"),
            text_or_empty(F.col("subject")).alias("_raw_subject"),
            F.lower(text_or_empty(F.col("subject"))).alias("_subject"),
            body.alias("_raw_body"),
            F.lower(body).alias("_body"),
        )
        unquoted = strip_quoted(self.body)
        if self.scan == "body":
            return lowered.select("*", self.body.alias("_content"), unquoted.alias("_unquoted"))
        return lowered.select(
            "*",
            F.concat_ws(" ", "_subject", "_body").alias("_content"),
            F.concat_ws(" ", self.subject, unquoted).alias("_unquoted"),
        )


def _sender_lists(f: _Fields) -> Column:
    return contains_any(f.sender, W.B2B_DOMAINS + W.B2B_ADDRESSES)


def _bulk_rules(f: _Fields, word_boundary: bool) -> list[tuple[Column, str, Column | None]]:
    def hit(col: Column, words) -> Column:
        return contains_any(col, words, word_boundary)

    listed = _sender_lists(f)
    return [
        (contains_any(f.sender, W.POSTAL_SENDERS), "R1a", None),
        (f.subject.startswith("re:") & ~listed & hit(f.content, W.PITCH_WORDS), "R1b", None),
        (listed | starts_with_any(f.sender, W.BULK_PREFIXES), "R1", None),
        (has_cjk(f.raw_subject) | contains_any(f.subject, W.PROMO_SUBJECTS), "R1.5", None),
        (hit(f.content, W.EVENT_WORDS), "R2", None),
        (hit(f.unquoted, W.B2B_WORDS + W.PROMO_WORDS), "R3", None),
    ]


def _cascade(staged: DataFrame, branches: list[tuple[Column, str, Column | None]], bulk=BULK_RULES) -> DataFrame:
    """Append ``rule_id`` and ``tag`` of the first branch that holds.

    The CASE yields both at once and passes through a one-element ``inline``: a later filter
    on the tag then reads the result. Pushed below a plain projection, the filter would
    repeat the whole cascade, and each lower-casing once per word.
    """
    none = F.lit(None).cast("string")

    def hit(rule_id: str, tag: Column | None) -> Column:
        value = F.lit(B2B) if rule_id in bulk else none if tag is None else tag
        return F.struct(F.lit(rule_id).alias("rule_id"), value.alias("tag"))

    chain = None
    for condition, rule_id, tag in branches:
        chain = (F if chain is None else chain).when(condition, hit(rule_id, tag))
    return staged.select("*", F.inline(F.array(chain.otherwise(hit("R4", None))))).drop(*FIELD_COLUMNS)


def prefilter(
    messages: DataFrame, scan: str = "content", body_chars: int | None = None, word_boundary: bool = False
) -> DataFrame:
    """Add ``rule_id`` and ``tag`` (bulk mail or null).

    Form, chat-relay, payment and marketplace senders pass untouched. ``scan='body'`` leaves
    the subject out of the content rules; ``body_chars`` limits the text looked at, by
    default all of it.
    """
    f = _Fields(scan, body_chars)
    branches = [
        (f.sender.contains(W.FORM_SENDER), "R0", None),
        (contains_any(f.sender, W.SYSTEM_MAILERS), "R0.1", None),
        (f.sender.contains(W.CHAT_RELAY), "R0.2", None),
        (contains_any(f.sender, W.PAYMENT_SENDERS + W.MARKET_SENDERS), "R0.5", None),
        *_bulk_rules(f, word_boundary),
    ]
    return _cascade(f.add(messages), branches)


def triage(
    messages: DataFrame, scan: str = "content", body_chars: int | None = None, word_boundary: bool = False
) -> DataFrame:
    """The full cascade: add ``rule_id``, ``tag`` and ``needs_model``."""
    f = _Fields(scan, body_chars)

    def by_region(words, issue: str) -> Column:
        return F.when(contains_any(f.body, words), f"LIFESTYLE_{issue}").otherwise(f"US_{issue}")

    def by_order(words, issue: str) -> Column:
        return (
            F.when(f.raw_body.rlike(US_ORDER), f"US_{issue}")
            .when(f.raw_body.rlike(INTL_ORDER), f"LIFESTYLE_{issue}")
            .otherwise(by_region(words, issue))
        )

    def disputed(dispute_words, region_words) -> Column:
        disputes = contains_any(f.body, dispute_words)
        return F.when(disputes, by_region(region_words, "CHARGEBACK")).otherwise(B2B)

    relay_bulk = contains_any(f.body, W.RELAY_SYSTEM_WORDS) & ~contains_any(f.body, W.RELAY_CUSTOMER_WORDS)
    asks_status = contains_any(f.body, W.STATUS_PHRASES) & f.raw_body.rlike(ANY_ORDER)
    branches = [
        (f.sender.contains(W.FORM_SENDER) & f.subject.contains(W.FORM_SUBJECT), "R0",
         by_order(W.FORM_REGION_WORDS, "WARRANTY")),
        (contains_any(f.sender, W.SYSTEM_MAILERS), "R0.1", None),
        (f.sender.contains(W.CHAT_RELAY), "R0.2", F.when(relay_bulk, B2B)),
        (contains_any(f.sender, W.PAYMENT_SENDERS), "R0.5", disputed(W.PAYMENT_DISPUTE_WORDS, W.PAYMENT_REGION_WORDS)),
        (contains_any(f.sender, W.MARKET_SENDERS), "R0.5", disputed(W.MARKET_DISPUTE_WORDS, W.MARKET_REGION_WORDS)),
        *_bulk_rules(f, word_boundary),
        (asks_status, "R3.5", by_order(W.STATUS_REGION_WORDS, "WISMO")),
    ]
    return _cascade(f.add(messages), branches).withColumn("needs_model", F.col("tag").isNull())


def rule_stats(classified: DataFrame) -> DataFrame:
    """Hits per rule."""
    return classified.groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))


def filter_rate(classified: DataFrame) -> DataFrame:
    """One row: how many messages the rules settled and how many need the model."""
    settled = F.count_if(F.col("tag").isNotNull())
    total = F.count(F.lit(1))
    return classified.agg(
        total.alias("fetched"),
        settled.alias("by_rules"),
        (total - settled).alias("to_model"),
        F.coalesce(F.round(F.try_divide(settled * 100.0, total), 1), F.lit(0.0)).alias("pct_by_rules"),
    )


def split_for_model(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows a rule settled and the rows an external model has to look at."""
    return classified.filter(F.col("tag").isNotNull()), classified.filter(F.col("tag").isNull())


def parse_model_reply(replies: DataFrame, col: str = "reply") -> DataFrame:
    """Read ``{"tag", "reason"}`` replies; a tag outside the taxonomy is rejected and nulled."""
    parsed = F.from_json(F.regexp_extract(F.col(col), r"(?s)\{.*\}", 0), "tag string, reason string")
    return (
        replies.withColumn("_reply", parsed)
        .withColumn("tag", F.when(F.col("_reply.tag").isin(*CLASSIFICATION), F.col("_reply.tag")))
        .withColumn("reason", F.col("_reply.reason"))
        .withColumn("rejected", F.col("tag").isNull())
        .drop("_reply")
    )


def apply_model(needs_model: DataFrame, classify_fn, schema: str) -> DataFrame:
    """Run a caller's ``classify_fn(iterator of pandas frames)`` over the rows the rules left open."""
    return needs_model.mapInPandas(classify_fn, schema)


RULE_TABLE = (
    "priority int, rule_id string, tag string, field string, op string, pattern string, "
    "guard_field string, guard_op string, guard_pattern string"
)


def default_rule_rows() -> list[tuple]:
    """The prefilter cascade as rows for ``classify_with_rules``; tags equal those of ``prefilter``.

    The listed senders come before the reply-pitch rule because that rule exempts them.
    """
    rows: list[tuple] = []

    def add(rule_id, tag, field, op, patterns, guard=(None, None, None)):
        rows.extend((len(rows) + i, rule_id, tag, field, op, p, *guard) for i, p in enumerate(patterns))

    add("R0", None, "sender", "contains", [W.FORM_SENDER])
    add("R0.1", B2B, "sender", "contains", W.SYSTEM_MAILERS)
    add("R0.2", None, "sender", "contains", [W.CHAT_RELAY])
    add("R0.5", None, "sender", "contains", W.PAYMENT_SENDERS + W.MARKET_SENDERS)
    add("R1a", B2B, "sender", "contains", W.POSTAL_SENDERS)
    add("R1", B2B, "sender", "contains", W.B2B_DOMAINS + W.B2B_ADDRESSES)
    add("R1b", B2B, "content", "contains", W.PITCH_WORDS, ("subject", "starts", "re:"))
    add("R1", B2B, "sender", "starts", W.BULK_PREFIXES)
    add("R1.5", B2B, "subject", "regex", ["[一-鿿]"])
    add("R1.5", B2B, "subject", "contains", W.PROMO_SUBJECTS)
    add("R2", B2B, "content", "contains", W.EVENT_WORDS)
    add("R3", B2B, "unquoted", "contains", W.B2B_WORDS + W.PROMO_WORDS)
    return rows


#: Rules that one automaton holds.
RULES_AT_A_TIME = 100_000
RULE_COLUMNS = ("priority", "rule_id", "tag", "field", "op", "pattern", "guard_field", "guard_op", "guard_pattern")
RULE_FIELDS = {"sender": "_sender", "subject": "_subject", "content": "_content", "unquoted": "_unquoted", "body": "_body"}


class RuleBlock:
    """Rules with their literal patterns in one automaton: a text is read once, however many patterns there are.

    ``regexes`` lists the (field, pattern) of regular expressions, whose results come with each message.
    """

    def __init__(self, rows: list[tuple], regexes: list[tuple[str, str]]):
        self.rows = sorted(rows, key=lambda r: [(x is not None, x) for x in r])  # nulls first, as Spark orders them
        self.at = {r: i for i, r in enumerate(regexes)}
        self.literal: dict[str, list[tuple[str, int, bool]]] = {}
        self.other: list[int] = []
        for rank, (_, _, _, field, op, pattern, *_) in enumerate(self.rows):
            if field not in RULE_FIELDS or pattern is None:
                continue
            if op in ("contains", "starts") and pattern:
                self.literal.setdefault(pattern, []).append((field, rank, op == "starts"))
            elif op in ("contains", "starts", "regex"):
                self.other.append(rank)
        self.automaton = ahocorasick.Automaton()
        for pattern in self.literal:
            self.automaton.add_word(pattern, pattern)
        if self.literal:
            self.automaton.make_automaton()
        self.fields = sorted({field for rules in self.literal.values() for field, *_ in rules})

    def holds(self, field: str, op: str, pattern: str, texts: dict, hits: list[bool]) -> bool:
        if field not in RULE_FIELDS or pattern is None:
            return False
        if op == "regex":
            return bool(hits[self.at[field, pattern]])
        return pattern in texts[field] if op == "contains" else op == "starts" and texts[field].startswith(pattern)

    def first(self, texts: dict[str, str], hits: list[bool]) -> tuple | None:
        """The first rule that matches."""
        best = len(self.rows)
        for field in self.fields:
            text, seen = texts[field], set()
            for end, pattern in self.automaton.iter(text):
                start = end - len(pattern) + 1
                if pattern in seen and start:
                    continue
                seen.add(pattern)
                for own, rank, at_start in self.literal[pattern]:
                    if rank < best and own == field and not (at_start and start) and self.guarded(rank, texts, hits):
                        best = rank
        for rank in self.other:
            if rank >= best:
                break
            _, _, _, field, op, pattern, *_ = self.rows[rank]
            if self.holds(field, op, pattern, texts, hits) and self.guarded(rank, texts, hits):
                best = rank
        return self.rows[best] if best < len(self.rows) else None

    def guarded(self, rank: int, texts: dict, hits: list[bool]) -> bool:
        field, op, pattern = self.rows[rank][6:]
        return field is None or self.holds(field, op, pattern, texts, hits)


def classify_with_rules(messages: DataFrame, rules: DataFrame, scan: str = "content") -> DataFrame:
    """The cascade with rules as data: the matching rule of lowest priority sets rule_id and tag.

    Rules with equal priority go by their other columns. The rules are dealt into blocks of bounded size, and each block becomes one
    automaton per task; messages are neither shuffled nor multiplied, and a message's cost hardly grows with the rules.
    Only the fields that a rule looks at are sent to Python, where one message is held at a time.
    Regular expressions are evaluated one by one as columns.
    """
    f = _Fields(scan, None)
    rows = rules.select(*RULE_COLUMNS)
    n_blocks = max(1, -(-rows.count() // RULES_AT_A_TIME))
    tests = [rows.filter(f"{k}op = 'regex' and {k}pattern is not null").select(f"{k}field", f"{k}pattern") for k in ("", "guard_")]
    regexes = sorted(tuple(r) for r in tests[0].union(tests[1]).distinct().collect() if r[0] in RULE_FIELDS)
    hits = F.array(*[F.regexp_like(F.col(RULE_FIELDS[field]), F.lit(pattern)) for field, pattern in regexes]) if regexes else F.array().cast("array<boolean>")
    kept = [c for c in messages.columns if c not in ("rule_id", "tag")]
    named = rows.select("field").union(rows.select("guard_field")).distinct().collect()
    fields = [field for field in RULE_FIELDS if (field,) in named]
    read = [RULE_FIELDS[field] for field in fields]
    found = f.add(messages).select(*kept, *read, hits.alias("_regex"), F.lit(None).cast(rows.schema).alias("_hit"))
    number = F.pmod(F.xxhash64(*RULE_COLUMNS), F.lit(n_blocks))
    for block in range(n_blocks):
        part = [tuple(r) for r in rows.filter(number == block).toLocalIterator()]
        after = found if block < n_blocks - 1 else found.drop(*read, "_regex")  # not sent back from the last block
        found = found.mapInArrow(_matcher(part, regexes, fields, after.columns), after.schema)
    hit = F.col("_hit")
    return found.withColumn("rule_id", F.coalesce(hit["rule_id"], F.lit("R4"))).withColumn("tag", hit["tag"]).drop("_hit")


def _matcher(part: list[tuple], regexes: list[tuple[str, str]], fields: list[str], kept: list[str]):
    """A step that sets ``_hit`` to the first matching rule of a block, unless an earlier block has one that goes before it.

    ``fields`` are those that the rules look at; the columns ``kept`` are given on.
    """

    def run(batches):
        block = RuleBlock(part, regexes)
        order = lambda r: [(x is not None, x) for x in r]
        for batch in batches:
            names = batch.schema.names
            columns = [batch.column(names.index(c)) for c in [*[RULE_FIELDS[field] for field in fields], "_regex", "_hit"]]
            after = []
            for row in zip(*columns, strict=True):  # by row, as the texts of a whole batch take much memory as Python's strings
                *texts, hits, before = (value.as_py() for value in row)
                hit = block.first({field: text or "" for field, text in zip(fields, texts, strict=True)}, hits)
                old = None if before is None else tuple(before.values())
                best = min([r for r in (hit, old) if r is not None], key=order, default=None)
                after.append(None if best is None else dict(zip(RULE_COLUMNS, best, strict=True)))
            kind = batch.schema.field("_hit").type
            yield batch.set_column(names.index("_hit"), "_hit", pa.array(after, kind)).select(kept)

    return run
