"""Mail tables derived from the given test tables, over all their rows and whole texts.

The given texts are invented words in which no rule would ever fire, so senders, subjects
and opening phrases are put in front of them by row number. ``oracle`` holds the same
derivations in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EPOCH = 1_704_067_200  # 2024-01-01 00:00:00 UTC
MAIL_NOW = "2024-01-31 00:00:00"
SHOP_NOW = "2001-08-03 00:00:00"
AGENT = "agent@support.example"

CATEGORIES = (
    "US_WISMO", "LIFESTYLE_WISMO", "US_WARRANTY", "LIFESTYLE_RETURN", "US_ADDRESS", "GENERAL_PRODUCT",
    "GENERAL_COMPATIBILITY",
)

# sender, subject, opening of the body; chosen by doc_id modulo the length of the list.
INBOX_CASES = (
    ("notifications@fillout.com", "Warranty Claim Form", "Serial Ms14501 "),
    ("notifications@fillout.com", "Warranty Claim Form", "Serial #77 "),
    ("notifications@fillout.com", "Warranty Claim Form", "overseas customer "),
    ("notifications@fillout.com", "Another Form", "hello "),
    ("mailer@shopify.com", "Store notice", "hello "),
    ("mailer@vanchat.io", "Chat", "uptime webhook "),
    ("mailer@vanchat.io", "Chat", "my tracking webhook "),
    ("service@paypal.com", "Notice", "a dispute from hk "),
    ("service@paypal.com", "Notice", "a reversal "),
    ("service@paypal.com", "Notice", "thanks "),
    ("seller@amazon.co.uk", "Notice", "a-to-z claim hk "),
    ("seller@amazon.ca", "Notice", "international refund request "),
    ("no_reply@post.example", "Parcel", "hello "),
    ("x@y.example", "Re: hello", "our agency "),
    ("x@y.example", "Re: hello", "we reply immediately "),
    ("a@qq.com", "Re: hello", "our agency "),
    ("noreply@x.example", "hello", "hello "),
    ('"X" <noreply@x.example>', "hello", "hello "),
    ("a@supplychain.amazon.com", "hello", "hello "),
    ("x@y.example", "你好", "hello "),
    ("x@y.example", "hello", "你好 "),
    ("x@y.example", "20% off", "hello "),
    ("x@y.example", "hello", "join our webinar "),
    ("x@y.example", "my claim", "thanks\n> see invoice\nbye "),
    ("x@y.example", "my claim", "see invoice "),
    ("Jane Roe <jane@y.example>", "question", "Where is my order Ms123? My leather case for iPhone 14 is loose. "),
    ("John <john@y.example>", "question", "Where is my order #12? "),
    ("x@y.example", "question", "Where is my order? "),
    ("x@y.example", "question", "Does the Influence case fit iPhone 16? URGENT!! "),
    ("x@y.example", "question", "My waterproof case for iPhone 14 BROKE AND LEAKS, my lawyer will sue "),
    ("gemini-notes@google.com", "Notes", "hello "),
    ("x@y.example", None, None),
)
LABEL_CASES = (
    "INBOX", "INBOX,AI_PROCESSED", "INBOX,AI_PROCESSED,US_WISMO", "INBOX,AI_PROCESSED,LIFESTYLE_WISMO",
    "INBOX,US_RETURN", "INBOX,AI_PROCESSED,US_WARRANTY,REVIEW_DRAFT", "INBOX,AI_PROCESSED,B2B_FILTERED",
    "INBOX,AI_PROCESSED,US_CHARGEBACK", "INBOX,AI_PROCESSED,GENERAL_PRODUCT", "INBOX,AI_PROCESSED,US_ADDRESS",
    "INBOX,AI_PROCESSED,LIFESTYLE_WISMO,ESCALATION_NEEDED",
)
DRAFT_LEADS = (
    "Certainly, rest assured. ", "I checked and we can see — it ships. ", "Not only fast but also kind. ",
    "Furthermore, the landscape is robust. ", "Hello. ",
)
INTENTS = ("replacement", "tracking_update", "refund", "compatibility", None)
RISKS = ("LOW", "LOW", "MEDIUM", "HIGH")
GRAPH_PAIRS = (
    ("the", "paragraph", "related", None), ("la", "der", "related", None), ("charging", "case", "related", None),
    ("of", "que", "related", None),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a file stream, be it one file or a folder of them; a stream takes one file only by a pattern."""
    schema = read(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


def pick(key: Column, values) -> Column:
    """The value at ``key`` modulo the number of values."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def at(seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(EPOCH) + seconds)


def _text_id(prefix: str, *cols: str) -> Column:
    return F.concat(F.lit(prefix), F.concat_ws("-", *[F.col(c).cast("string") for c in cols]))


def messages(spark: SparkSession, sf_dir: str, source=read) -> DataFrame:
    """Thread mail: one row per conversation turn."""
    c = source(spark, sf_dir, "conversations")
    sender = (
        F.when(F.col("role") == "assistant", f"Support <{AGENT}>")
        .when(F.col("role") == "system", "noreply@mail.example")
        .otherwise(F.concat(F.lit("user"), (F.col("conv_id") % 50).cast("string"), F.lit("@mail.example")))
    )
    return c.select(
        _text_id("M", "conv_id", "turn").alias("message_id"), _text_id("T", "conv_id").alias("thread_id"),
        at(F.col("conv_id") * 7 % 720 * 3600 + F.col("turn") * 2100).alias("received_at"), sender.alias("sender"),
        F.col("text").alias("body"), F.split(pick(F.col("conv_id") + F.col("turn"), LABEL_CASES), ",").alias("labels"),
        (F.col("turn") % 2 == 0).alias("is_unread"), "role", "conv_id", "turn",
    )


def inbox(spark: SparkSession, sf_dir: str, source=read) -> DataFrame:
    """Inbox mail: one row per document, whole text behind an opening phrase."""
    d = source(spark, sf_dir, "documents")
    sender, subject, lead = (pick(F.col("doc_id"), column) for column in zip(*INBOX_CASES))
    return d.select(
        _text_id("I", "doc_id").alias("message_id"),
        F.concat(F.lit("T"), (F.col("doc_id") % 97).cast("string")).alias("thread_id"),
        at(F.col("doc_id") * 6151 % 2_592_000).alias("received_at"),
        sender.alias("sender"), subject.alias("subject"), F.concat(lead, F.col("text")).alias("body"),
        F.split(pick(F.col("doc_id"), LABEL_CASES), ",").alias("labels"),
        (F.col("doc_id") % 3 != 0).alias("is_unread"), "doc_id",
    )


def drafts(spark: SparkSession, sf_dir: str, source=read) -> DataFrame:
    """A pending draft per assistant turn."""
    m = messages(spark, sf_dir, source).filter(F.col("role") == "assistant")
    return m.select(
        _text_id("D", "conv_id", "turn").alias("draft_id"), "thread_id", "message_id",
        F.col("received_at").alias("created_at"), pick(F.col("conv_id"), CATEGORIES).alias("email_category"),
        F.lit("user@mail.example").alias("sender_email"), F.lit("hello").alias("subject"),
        F.col("body").alias("draft_text"), F.lit("us").alias("store"), F.lit("PENDING").alias("status"),
        "conv_id", "turn",
    )


def sent(spark: SparkSession, sf_dir: str, source=read) -> DataFrame:
    """The reply to each draft, kept, extended or changed; conversations of the system get none."""
    system = read(spark, sf_dir, "conversations").filter(F.col("role") == "system").select("conv_id").distinct()
    d = drafts(spark, sf_dir, source).join(system, "conv_id", "left_anti")
    how = F.col("conv_id") % 5
    text = F.col("draft_text")
    body = (
        F.when(how == 0, text).when(how == 1, F.concat(text, F.lit(" Thanks.")))
        .when(how == 2, F.replace(text, F.lit("e"), F.lit("a")))
        .when(how == 3, F.concat(F.lit("Dear customer, "), F.replace(text, F.lit(" "), F.lit(""))))
        .otherwise(F.reverse(text))
    )
    return d.select(
        "thread_id", _text_id("S", "conv_id", "turn").alias("message_id"), "subject", body.alias("body"),
        (F.col("created_at") + F.expr("INTERVAL 10 MINUTES")).alias("sent_at"), "conv_id", "turn",
    )


def draft_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long draft log, one row per order."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        _text_id("D", "o_orderkey").alias("draft_id"),
        F.nullif(pick(F.col("o_orderkey"), CATEGORIES), F.lit("GENERAL_COMPATIBILITY")).alias("email_category"),
        F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "F", "RECONCILED")
        .otherwise("ABANDONED").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.element_at(F.array(*[F.lit(s) for s in ("POSITIVE", "NEUTRAL", "FRUSTRATED", "ANGRY", "URGENT")]),
                     F.left("o_orderpriority", F.lit(1)).cast("int")).alias("sentiment"),
        pick(F.col("o_custkey"), INTENTS).alias("primary_intent"), pick(F.col("o_custkey"), RISKS).alias("escalation_risk"),
    )


def accuracy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long accuracy log, one row per order line; better scores for some categories."""
    from ..functions.scoring import accuracy_score, result_band

    pct = F.when(F.col("l_orderkey") % 7 == 2, F.round(F.col("l_discount") * 10, 4)).otherwise(
        F.round(F.col("l_discount") * F.col("l_quantity") * 20, 4)
    )
    return read(spark, sf_dir, "lineitem").select(
        _text_id("D", "l_orderkey").alias("draft_id"), F.col("l_shipdate").cast("timestamp").alias("reconciled_at"),
        pct.alias("edit_pct"), accuracy_score(pct).alias("accuracy_score"), result_band(pct).alias("result"),
    )


def shop_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their last shipping date; orders without lines are not fulfilled."""
    shipped = (
        read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.max("l_shipdate").cast("timestamp").alias("fulfilled_at"))
    )
    key = F.col("o_orderkey")
    us = key % 2 == 0
    done = F.col("fulfilled_at").isNotNull()
    return read(spark, sf_dir, "orders").join(shipped, "o_orderkey", "left").select(
        F.when(us, "us").otherwise("lifestyle").alias("store"),
        F.concat(F.when(us, "Ms").otherwise("#"), key.cast("string")).alias("order_no"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(done, "fulfilled").otherwise("unfulfilled").alias("fulfillment_status"),
        F.when(done & (key % 3 != 0), F.concat(F.lit("https://track.example/"), key.cast("string"))).alias("tracking_url"),
        F.when(done, pick(key, ("UPS", "DHL", None))).alias("carrier"),
        "fulfilled_at",
        F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "O", "in_transit")
        .alias("shipment_status"),
        F.when(key % 5 != 0, F.date_add(F.to_date("fulfilled_at"), 5)).alias("estimated_delivery_date"),
        F.when(F.col("o_orderstatus") == "F", F.col("fulfilled_at") + F.expr("INTERVAL 3 DAYS")).alias("delivered_at"),
    )


def order_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about each order; some name an unknown order, some none."""
    key = F.col("o_orderkey")
    us = key % 2 == 0
    number = F.when(key % 17 == 0, "").otherwise(
        F.concat(F.when(us, "Ms").otherwise("#"), F.when(key % 10 == 9, key + 100_000_000).otherwise(key).cast("string"))
    )
    return read(spark, sf_dir, "orders").select(
        _text_id("Q", "o_orderkey").alias("message_id"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(" <c@mail.example>")).alias("sender"),
        F.concat(F.lit("Hello, where is my order "), number, F.lit("? Thanks.")).alias("body"),
        F.when(us, "US_WISMO").otherwise("LIFESTYLE_WISMO").alias("tag"),
        F.split(F.when(us, "AI_PROCESSED,US_WISMO").otherwise("AI_PROCESSED,LIFESTYLE_WISMO"), ",").alias("labels"),
    )


def summary(text: str):
    """What the texts of a group come to, as a line of bounded size that depends on all of them."""
    digest = F.md5(text)
    return F.concat(
        F.count("*").cast("string"), F.lit(" documents of "), F.sum(F.length(text)).cast("string"), F.lit(" letters from "), F.min(digest),
        F.lit(" to "), F.max(digest),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge-base entries with text and vector: documents that have an embedding."""
    v = read(spark, sf_dir, "embeddings")
    d = read(spark, sf_dir, "documents")
    return v.join(d, v["vec_id"] == d["doc_id"]).select(
        F.col("vec_id").alias("kb_id"), F.col("label").alias("category"), F.col("text"), F.col("embedding").alias("vector")
    )


def as_queries(entry_rows: DataFrame) -> DataFrame:
    return entry_rows.withColumnRenamed("kb_id", "query_id")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as entries of their source's category."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("kb_id"), F.col("source").alias("category"), "text"
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a query in some category."""
    return messages(spark, sf_dir).select(
        F.col("message_id").alias("query_id"),
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("category"), F.col("body").alias("text"),
    )


def hashed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as parsed entries with their content hash."""
    from ..operators.kb import with_content_hash

    return with_content_hash(
        read(spark, sf_dir, "documents").select(
            "doc_id", F.concat(F.col("source"), F.lit(".md")).alias("filename"), F.col("doc_id").alias("position"),
            F.col("lang").alias("canonical_question"), F.col("text").alias("canonical_answer"),
        )
    )


def user_events(spark: SparkSession, sf_dir: str, source=read) -> DataFrame:
    """Events as the mail of one thread per user."""
    return source(spark, sf_dir, "events").select(
        F.concat(F.lit("E"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("message_id"),
        _text_id("U", "user_id").alias("thread_id"), F.col("ts").cast("timestamp").alias("received_at"),
        F.when(F.col("event_type") == "purchase", AGENT).otherwise("user@mail.example").alias("sender"),
        F.col("props").alias("body"), "event_type", F.col("value").alias("accuracy_score"),
    )
