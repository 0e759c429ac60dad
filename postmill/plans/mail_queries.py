"""Queries over mail: rules, label states, threads, orders, drafts, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import dates, rule_words as W, text as X
from ..functions.tags import CHARGEBACKS, CLASSIFICATION, DRAFTABLE, store_of
from ..operators import drafts as drafting, labels as L, orders as O, rules as R, threads as T
from ..schemas import DRAFT_LOG, evolve
from ..sources import mime, scans, staging
from . import views as V
from .catalog import query
from .oracle import any_of, has, pick, starts, text, with_tables

NL = "chr(10)"
def customer() -> Column:
    return F.col("event_type") != "purchase"


def joined(col) -> Column:
    return F.array_join(F.array_sort(col), ",")


FIELDS = f"""
    SELECT *, lower(sender) AS s, lower(coalesce(subject, '')) AS su, coalesce(body, '') AS rb, lower(rb) AS b,
           su || ' ' || b AS content,
           su || ' ' || array_to_string(list_filter(string_split(b, {NL}),
               lambda l: NOT starts_with(ltrim(l, ' ' || chr(9)), '>')), {NL}) AS unquoted,
           {any_of('lower(sender)', W.B2B_DOMAINS + W.B2B_ADDRESSES)} AS listed
    FROM inbox"""
BULK = f"""
    WHEN {any_of('s', W.POSTAL_SENDERS)} THEN 'R1a'
    WHEN starts_with(su, 're:') AND {any_of('content', W.PITCH_WORDS)} AND NOT listed THEN 'R1b'
    WHEN listed OR {starts('s', W.BULK_PREFIXES)} THEN 'R1'
    WHEN regexp_matches(coalesce(subject, ''), '[一-鿿]') OR {any_of('su', W.PROMO_SUBJECTS)} THEN 'R1.5'
    WHEN {any_of('content', W.EVENT_WORDS)} THEN 'R2'
    WHEN {any_of('unquoted', W.B2B_WORDS)} OR {any_of('unquoted', W.PROMO_WORDS)} THEN 'R3'"""
BULK_IDS = "('R0.1', 'R1a', 'R1b', 'R1', 'R1.5', 'R2', 'R3')"
PREFILTERED = f"""
    SELECT *, CASE WHEN contains(s, 'notifications@fillout.com') THEN 'R0'
        WHEN contains(s, 'mailer@shopify.com') THEN 'R0.1' WHEN contains(s, 'mailer@vanchat.io') THEN 'R0.2'
        WHEN {any_of('s', W.PAYMENT_SENDERS + W.MARKET_SENDERS)} THEN 'R0.5' {BULK} ELSE 'R4' END AS rule_id,
        CASE WHEN rule_id IN {BULK_IDS} THEN 'B2B_FILTERED' END AS tag
    FROM f"""


def _region(words, issue: str) -> str:
    return f"CASE WHEN {any_of('b', words)} THEN 'LIFESTYLE_{issue}' ELSE 'US_{issue}' END"


def _number(words, issue: str) -> str:
    return (
        f"CASE WHEN regexp_matches(rb, 'Ms[0-9]+') THEN 'US_{issue}' "
        f"WHEN regexp_matches(rb, '#[0-9]+') THEN 'LIFESTYLE_{issue}' ELSE {_region(words, issue)} END"
    )


RULED = f"""
    SELECT *, CASE
        WHEN contains(s, 'notifications@fillout.com') AND contains(su, 'warranty claim form') THEN 'R0'
        WHEN contains(s, 'mailer@shopify.com') THEN 'R0.1' WHEN contains(s, 'mailer@vanchat.io') THEN 'R0.2'
        WHEN {any_of('s', W.PAYMENT_SENDERS)} THEN 'pay' WHEN {any_of('s', W.MARKET_SENDERS)} THEN 'market' {BULK}
        WHEN {any_of('b', W.STATUS_PHRASES)} AND regexp_matches(rb, 'Ms[0-9]+|#[0-9]+') THEN 'R3.5'
        ELSE 'R4' END AS r
    FROM f"""
TRIAGED = f"""
    SELECT message_id, thread_id, received_at, sender, body, labels, is_unread,
        CASE WHEN r IN ('pay', 'market') THEN 'R0.5' ELSE r END AS rule_id,
        CASE WHEN r IN {BULK_IDS} THEN 'B2B_FILTERED'
             WHEN r = 'R0' THEN {_number(W.FORM_REGION_WORDS, 'WARRANTY')}
             WHEN r = 'R0.2' AND {any_of('b', W.RELAY_SYSTEM_WORDS)} AND NOT {any_of('b', W.RELAY_CUSTOMER_WORDS)}
                 THEN 'B2B_FILTERED'
             WHEN r = 'pay' THEN CASE WHEN {any_of('b', W.PAYMENT_DISPUTE_WORDS)}
                 THEN {_region(W.PAYMENT_REGION_WORDS, 'CHARGEBACK')} ELSE 'B2B_FILTERED' END
             WHEN r = 'market' THEN CASE WHEN {any_of('b', W.MARKET_DISPUTE_WORDS)}
                 THEN {_region(W.MARKET_REGION_WORDS, 'CHARGEBACK')} ELSE 'B2B_FILTERED' END
             WHEN r = 'R3.5' THEN {_number(W.STATUS_REGION_WORDS, 'WISMO')} END AS tag,
        tag IS NULL AS needs_model
    FROM ruled"""
PRE = {"f": FIELDS, "pre": PREFILTERED}
TRI = {"f": FIELDS, "ruled": RULED, "tri": TRIAGED}


def tri_sql(body: str, **more: str) -> str:
    return with_tables(body, "inbox", extra={**TRI, **more})


@query(with_tables(
    "SELECT message_id, received_at FROM inbox WHERE received_at >= TIMESTAMP '2024-01-24' "
    "AND NOT list_contains(labels, 'AI_PROCESSED')", "inbox"))
def inbox_scan(spark: SparkSession, d: str) -> DataFrame:
    return scans.inbox_scan(V.inbox(spark, d), V.MAIL_NOW).select("message_id", "received_at")


@query(with_tables("SELECT message_id, sent_at FROM sent WHERE sent_at >= TIMESTAMP '2024-01-19'", "sent"))
def sent_scan(spark: SparkSession, d: str) -> DataFrame:
    return scans.sent_scan(V.sent(spark, d), "2024-01-20 00:30:00").select("message_id", "sent_at")


@query(with_tables(
    "SELECT message_id, sent_at FROM sent WHERE sent_at >= TIMESTAMP '2024-01-19' "
    "ORDER BY sent_at DESC, message_id LIMIT 50", "sent"))
def sent_scan_page(spark: SparkSession, d: str) -> DataFrame:
    return scans.sent_scan(V.sent(spark, d), "2024-01-20 00:30:00", limit=50).select("message_id", "sent_at")


@query(with_tables("SELECT message_id, rule_id, tag FROM pre", "inbox", extra=PRE))
def prefilter(spark: SparkSession, d: str) -> DataFrame:
    return R.prefilter(V.inbox(spark, d)).select("message_id", "rule_id", "tag")


@query(tri_sql("SELECT message_id, rule_id, tag, needs_model FROM tri"))
def triage(spark: SparkSession, d: str) -> DataFrame:
    return R.triage(V.inbox(spark, d)).select("message_id", "rule_id", "tag", "needs_model")


@query(with_tables("SELECT message_id, tag FROM pre", "inbox", extra=PRE))
def rules_as_data(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(R.default_rule_rows(), R.RULE_TABLE)
    return R.classify_with_rules(V.inbox(spark, d), rules).select("message_id", "tag")


@query(tri_sql("SELECT rule_id, count(*) AS hits FROM tri GROUP BY 1"))
def rule_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.rule_stats(R.triage(V.inbox(spark, d)))


@query(tri_sql(
    "SELECT count(*) AS fetched, count(tag) AS by_rules, count(*) - count(tag) AS to_model, "
    "round(count(tag) * 100.0 / count(*), 1) AS pct_by_rules FROM tri"))
def filter_rate(spark: SparkSession, d: str) -> DataFrame:
    return R.filter_rate(R.triage(V.inbox(spark, d)))


@query(tri_sql("SELECT message_id, 'by_rules' AS part FROM tri WHERE tag IS NOT NULL "
               "UNION ALL SELECT message_id, 'to_model' FROM tri WHERE tag IS NULL"))
def split_for_model(spark: SparkSession, d: str) -> DataFrame:
    settled, rest = R.split_for_model(R.triage(V.inbox(spark, d)))
    return settled.select("message_id", F.lit("by_rules").alias("part")).unionByName(
        rest.select("message_id", F.lit("to_model").alias("part")))


REPLY_TAGS = ("US_WISMO", "GENERAL_PRODUCT", "NO_SUCH_TAG", "B2B_FILTERED")


@query(f"""
    SELECT doc_id, CASE WHEN t <> 'NO_SUCH_TAG' THEN t END AS tag, source AS reason, t = 'NO_SUCH_TAG' AS rejected
    FROM (SELECT doc_id, source, {pick('doc_id', REPLY_TAGS)} AS t FROM documents)""")
def model_reply(spark: SparkSession, d: str) -> DataFrame:
    record = F.to_json(F.struct(V.pick(F.col("doc_id"), REPLY_TAGS).alias("tag"), F.col("source").alias("reason")))
    replies = V.read(spark, d, "documents").select("doc_id", F.concat(F.lit("Here:\n"), record, F.lit("\n")).alias("reply"))
    return R.parse_model_reply(replies).select("doc_id", "tag", "reason", "rejected")


@query(with_tables(f"""
    SELECT message_id, CASE WHEN NOT list_contains(labels, 'AI_PROCESSED') THEN 'new'
        WHEN {has('labels', CLASSIFICATION)} THEN 'skip' WHEN is_unread THEN 'rerun' ELSE 'skip' END AS state
    FROM inbox""", "inbox"))
def processing_state(spark: SparkSession, d: str) -> DataFrame:
    return L.processing_state(V.inbox(spark, d)).select("message_id", "state")


QUEUE = f"""
    SELECT *, CASE WHEN {has('labels', DRAFTABLE)} THEN 'A' ELSE 'B' END AS search FROM inbox
    WHERE received_at >= TIMESTAMP '2024-01-24' AND is_unread AND list_contains(labels, 'AI_PROCESSED')
      AND NOT {has('labels', ('REVIEW_DRAFT', 'B2B_FILTERED', *CHARGEBACKS))}"""
CHECKED = f"""
    SELECT q.*, CASE
        WHEN search = 'B' AND NOT EXISTS (SELECT 1 FROM inbox p WHERE p.thread_id = q.thread_id
             AND (p.received_at, p.message_id) < (q.received_at, q.message_id)) THEN 'RETRIAGE'
        WHEN contains(lower(sender), 'notifications@fillout.com') THEN 'SKIP'
        WHEN {any_of('lower(sender)', W.MACHINE_SENDERS + W.B2B_DOMAINS + W.B2B_ADDRESSES)} THEN 'MISLABELED'
        ELSE 'PROCEED' END AS outcome
    FROM queue q"""


@query(with_tables("SELECT message_id, search FROM queue", "inbox", extra={"queue": QUEUE}))
def eligible(spark: SparkSession, d: str) -> DataFrame:
    return L.eligible(V.inbox(spark, d), V.MAIL_NOW).select("message_id", "search")


@query(with_tables("SELECT message_id FROM queue", "inbox", extra={"queue": QUEUE}))
def merged_searches(spark: SparkSession, d: str) -> DataFrame:
    mail = V.inbox(spark, d)
    found = (L.eligible_classified(mail, V.MAIL_NOW), L.eligible_replies(mail, V.MAIL_NOW),
             L.eligible_classified(mail, V.MAIL_NOW))
    return L.merge_searches(*found).select("message_id")


@query(with_tables("SELECT message_id, search, outcome FROM checked", "inbox", extra={"queue": QUEUE, "checked": CHECKED}))
def preflight(spark: SparkSession, d: str) -> DataFrame:
    mail = V.inbox(spark, d)
    return L.preflight(L.eligible(mail, V.MAIL_NOW), mail).select("message_id", "search", "outcome")


@query(with_tables(f"""
    SELECT message_id, array_to_string(list_sort(CASE WHEN outcome = 'MISLABELED'
        THEN list_distinct(list_append(list_filter(labels, lambda l: l NOT IN ({', '.join(map(text, CLASSIFICATION))})),
             'B2B_FILTERED')) ELSE labels END), ',') AS labels
    FROM checked""", "inbox", extra={"queue": QUEUE, "checked": CHECKED}))
def correct_mislabeled(spark: SparkSession, d: str) -> DataFrame:
    mail = V.inbox(spark, d)
    checked = L.preflight(L.eligible(mail, V.MAIL_NOW), mail)
    return L.correct_mislabeled(checked).select("message_id", joined("labels").alias("labels"))


@query(with_tables("SELECT 'draft' AS step, outcome, count(*) AS n FROM checked GROUP BY 2",
                   "inbox", extra={"queue": QUEUE, "checked": CHECKED}))
def step_report(spark: SparkSession, d: str) -> DataFrame:
    mail = V.inbox(spark, d)
    return L.step_report(L.preflight(L.eligible(mail, V.MAIL_NOW), mail), "draft")


OUTCOMES = ("PROCEED", "MISLABELED", "SKIP", "RETRIAGE")


@query(with_tables(
    "SELECT " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o.lower()}" for o in OUTCOMES) + " FROM checked",
    "inbox", extra={"queue": QUEUE, "checked": CHECKED}))
def step_summary(spark: SparkSession, d: str) -> DataFrame:
    mail = V.inbox(spark, d)
    return L.step_summary(L.preflight(L.eligible(mail, V.MAIL_NOW), mail), OUTCOMES)


@query(tri_sql("""
    SELECT message_id, array_to_string(list_sort(list_distinct(CASE WHEN tag IS NULL THEN labels
        ELSE list_concat(labels, [tag, 'AI_PROCESSED']) END)), ',') AS labels FROM tri"""))
def apply_classification(spark: SparkSession, d: str) -> DataFrame:
    return L.apply_classification(R.triage(V.inbox(spark, d))).select("message_id", joined("labels").alias("labels"))


@query(with_tables("""
    SELECT message_id, array_to_string(list_sort(list_distinct(list_append(labels, 'REVIEW_DRAFT'))), ',') AS labels
    FROM inbox""", "inbox"))
def mark_drafted(spark: SparkSession, d: str) -> DataFrame:
    return L.mark_drafted(V.inbox(spark, d)).select("message_id", joined("labels").alias("labels"))


@query(with_tables(f"""
    SELECT message_id, cleanup, array_to_string(list_sort(CASE WHEN cleanup = 'pending' THEN labels
        ELSE list_filter(labels, lambda l: l <> 'REVIEW_DRAFT') END), ',') AS labels
    FROM (SELECT *, CASE WHEN thread_id IN (SELECT thread_id FROM messages WHERE contains(sender, '{V.AGENT}'))
            THEN 'replied' WHEN NOT is_unread THEN 'read' ELSE 'pending' END AS cleanup
          FROM messages WHERE list_contains(labels, 'REVIEW_DRAFT'))""", "messages"))
def cleanup(spark: SparkSession, d: str) -> DataFrame:
    done = L.cleanup(V.messages(spark, d), V.AGENT)
    return done.select("message_id", "cleanup", joined("labels").alias("labels"))


@query(with_tables(f"""
    SELECT message_id FROM messages
    WHERE conv_id % 9 <> 0 AND thread_id IN (SELECT thread_id FROM messages WHERE contains(sender, '{V.AGENT}'))""", "messages"))
def threads_with_agent(spark: SparkSession, d: str) -> DataFrame:
    """Some conversations carry a blank thread id, which is no thread."""
    mail = V.messages(spark, d).withColumn("thread_id", F.when(F.col("conv_id") % 9 == 0, "").otherwise(F.col("thread_id")))
    return L.threads_with_agent(mail, V.AGENT).select("message_id")


@query(with_tables(f"""
    SELECT thread_id, last_sender, contains(last_sender, '{V.AGENT}') AS attended
    FROM (SELECT thread_id, arg_max(sender, turn) AS last_sender FROM messages GROUP BY 1)""", "messages"))
def attended_by_last_sender(spark: SparkSession, d: str) -> DataFrame:
    return L.attended_by_last_sender(V.messages(spark, d), V.AGENT)


@query(tri_sql("""
    SELECT tag, slot, batch, array_to_string(list(message_id ORDER BY message_id), ',') AS ids
    FROM (SELECT tag, date_trunc('hour', received_at) AS slot, message_id,
            CAST(floor((row_number() OVER (PARTITION BY tag, date_trunc('hour', received_at) ORDER BY message_id) - 1)
              / 2) AS BIGINT) AS batch FROM tri WHERE tag IS NOT NULL)
    GROUP BY 1, 2, 3"""))
def label_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = L.label_batches(R.triage(V.inbox(spark, d)), size=2)
    return rows.select("tag", "slot", "batch", F.array_join("message_ids", ",").alias("ids"))


@query(with_tables("SELECT message_id FROM messages WHERE (SELECT count(*) FROM order_mail WHERE tag = 'US_WISMO') > 0",
                   "messages", "order_mail"))
def only_if_category(spark: SparkSession, d: str) -> DataFrame:
    return L.only_if_category(V.messages(spark, d), V.order_mail(spark, d), ["US_WISMO"]).select("message_id")


@query(with_tables("""
    SELECT hour(received_at + INTERVAL 1 HOUR) BETWEEN 6 AND 22 AS in_hours,
           isodow(received_at + INTERVAL 1 HOUR) = 1 AS monday, count(*) AS n
    FROM user_events GROUP BY 1, 2""", "user_events"))
def business_hours(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("received_at")
    return V.user_events(spark, d).groupBy(
        dates.in_business_hours(ts).alias("in_hours"), dates.is_local_monday(ts).alias("monday")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(with_tables("""
    SELECT thread_id, array_to_string(list(message_id ORDER BY turn), ',') AS ids
    FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY turn DESC) AS n FROM messages)
    WHERE n <= 5 GROUP BY 1""", "messages"))
def thread_context(spark: SparkSession, d: str) -> DataFrame:
    context = T.thread_context(V.messages(spark, d))
    return context.select("thread_id", F.array_join("context.message_id", ",").alias("ids"))


@query(with_tables("SELECT thread_id, arg_max(sender, turn) AS last_sender FROM messages GROUP BY 1", "messages"))
def last_sender(spark: SparkSession, d: str) -> DataFrame:
    return T.last_sender(V.messages(spark, d))


@query(with_tables("""
    SELECT message_id, thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY received_at, message_id) AS contact_no
    FROM user_events WHERE event_type <> 'purchase'""", "user_events"))
def contact_index(spark: SparkSession, d: str) -> DataFrame:
    return T.contact_index(V.user_events(spark, d), customer()).select("message_id", "thread_id", "contact_no")


@query(with_tables("""
    SELECT thread_id, count(*) FILTER (event_type <> 'purchase') AS contacts FROM user_events GROUP BY 1""", "user_events"))
def thread_sizes(spark: SparkSession, d: str) -> DataFrame:
    return T.thread_sizes(V.user_events(spark, d), customer())


@query(with_tables("""
    SELECT message_id, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id
        ORDER BY received_at, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS prior_commitment
    FROM user_events""", "user_events"))
def prior_commitment(spark: SparkSession, d: str) -> DataFrame:
    rows = T.prior_commitment(V.user_events(spark, d), F.col("event_type") == "purchase")
    return rows.select("message_id", "prior_commitment")


@query(with_tables("""
    SELECT message_id FROM (SELECT message_id, row_number() OVER (PARTITION BY thread_id
        ORDER BY received_at, message_id) AS n FROM user_events) WHERE n = 1""", "user_events"))
def first_contacts(spark: SparkSession, d: str) -> DataFrame:
    mail = V.user_events(spark, d)
    return T.without_prior(mail, mail).select("message_id")


NUMBERED = r"""
    SELECT *, CASE WHEN starts_with(tag, 'US_') THEN 'us' ELSE 'lifestyle' END AS store,
        nullif(CASE WHEN starts_with(tag, 'US_') THEN regexp_extract(body, 'Ms[0-9]+')
                    ELSE regexp_extract(body, '#[0-9]+') END, '') AS order_no
    FROM order_mail"""
ROUTED = """
    SELECT m.*, o.created_at, o.tracking_url, o.carrier, o.fulfilled_at, o.shipment_status, o.estimated_delivery_date,
        o.delivered_at, date_diff('day', o.created_at, TIMESTAMP '2001-08-03') AS age,
        CASE WHEN m.order_no IS NULL THEN 'RETRIAGE' WHEN o.order_no IS NULL THEN 'ORDER_ERROR'
             WHEN o.tracking_url IS NOT NULL AND o.shipment_status IS DISTINCT FROM 'delivered' THEN 'A'
             WHEN o.tracking_url IS NOT NULL THEN 'A2' WHEN age > 3 THEN 'B' ELSE 'C' END AS route
    FROM numbered m LEFT JOIN shop_orders o ON o.store = m.store AND o.order_no = m.order_no"""
RT = {"numbered": NUMBERED, "routed": ROUTED}


def _routed(spark: SparkSession, d: str) -> DataFrame:
    return O.route_orders(V.order_mail(spark, d), V.shop_orders(spark, d), V.SHOP_NOW)


@query(with_tables("SELECT * FROM shop_orders", "shop_orders"))
def shop_orders(spark: SparkSession, d: str) -> DataFrame:
    return V.shop_orders(spark, d)


@query(with_tables("SELECT message_id, store, order_no, route, CAST(age AS INTEGER) AS order_age_days FROM routed",
                   "order_mail", "shop_orders", extra=RT))
def route_orders(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).select("message_id", "store", "order_no", "route", "order_age_days")


@query(with_tables("SELECT tag, route, count(*) AS n FROM routed GROUP BY 1, 2", "order_mail", "shop_orders", extra=RT))
def route_report(spark: SparkSession, d: str) -> DataFrame:
    return O.route_report(_routed(spark, d))


@query(with_tables("""
    SELECT message_id, array_to_string(list_sort(CASE route WHEN 'B' THEN list_append(labels, 'ESCALATION_NEEDED')
        WHEN 'A' THEN list_append(labels, 'REVIEW_DRAFT') WHEN 'A2' THEN list_append(labels, 'REVIEW_DRAFT')
        WHEN 'C' THEN list_append(labels, 'REVIEW_DRAFT') ELSE labels END), ',') AS labels
    FROM routed""", "order_mail", "shop_orders", extra=RT))
def mark_routed(spark: SparkSession, d: str) -> DataFrame:
    return L.mark_routed(_routed(spark, d)).select("message_id", joined("labels").alias("labels"))


@query(with_tables("""
    SELECT message_id, CASE WHEN list_contains(labels, 'US_WISMO') THEN 'US_WISMO' ELSE 'LIFESTYLE_WISMO' END AS tag
    FROM inbox WHERE received_at >= TIMESTAMP '2024-01-24' AND is_unread
      AND list_has_any(labels, ['US_WISMO', 'LIFESTYLE_WISMO'])
      AND NOT list_has_any(labels, ['REVIEW_DRAFT', 'ESCALATION_NEEDED'])""", "inbox"))
def wismo_queue(spark: SparkSession, d: str) -> DataFrame:
    return O.wismo_queue(V.inbox(spark, d), V.MAIL_NOW).select("message_id", "tag")


def _long(ts: str) -> str:
    return f"strftime({ts}, '%B %d, %Y')"


SIGN = "'', 'Warm regards,', 'Customer Support', 'our shop Support'"
_CHECK_BY = (
    "CAST(delivered_at AS DATE) + CASE isodow(delivered_at) WHEN 4 THEN 4 WHEN 5 THEN 4 WHEN 6 THEN 3 ELSE 2 END"
)


@query(with_tables(f"""
    SELECT message_id, route, CASE route
      WHEN 'A' THEN concat_ws({NL}, 'Hi Customer,', '', 'Thank you for reaching out! Here is the latest on your order.', '',
        'Order: ' || order_no, 'Placed: ' || {_long('created_at')}, 'Status: Shipped', '', '📦 Tracking Information',
        'Your order was shipped via ' || carrier || ' and can be tracked here: ' || tracking_url, '',
        'Estimated delivery: ' || {_long('estimated_delivery_date')}, '',
        'If your tracking has not updated in the last 48 hours or your estimated delivery date has passed, ' ||
        'reply to this email and we will look into it right away.', '',
        'Thank you for choosing our shop. We appreciate your patience and support.', {SIGN})
      WHEN 'C' THEN concat_ws({NL}, 'Hi Customer,', '', 'Thanks for reaching out! Your order ' || order_no ||
        ' is currently being prepared for shipment.', '', 'Expected ship date: ' || {_long('fulfilled_at')},
        'You will receive a tracking confirmation email as soon as it is on its way.', '',
        'We appreciate your patience. Great things are worth the wait!', {SIGN})
      WHEN 'A2' THEN concat_ws({NL}, 'Hi Customer,', '', 'We are sorry to hear your package has not arrived! Your order '
        || order_no || ' was marked as delivered on ' || {_long('delivered_at')} || '.', '',
        'Here are a few quick steps to check:', '',
        '- Confirm the delivery address on your order matches your current address',
        '- Check with neighbors or building management for any held packages',
        '- Allow 1 to 2 business days, as carriers sometimes mark items delivered early', '',
        'If it still has not arrived after ' || {_long(_CHECK_BY)} ||
        ', reply to this email and we will open an investigation with ' || carrier || ' on your behalf.', {SIGN})
      END AS draft_text
    FROM routed""", "order_mail", "shop_orders", extra=RT))
def fill_templates(spark: SparkSession, d: str) -> DataFrame:
    return O.fill_templates(_routed(spark, d)).select("message_id", "route", "draft_text")


@query(with_tables(r"""
    SELECT message_id, CASE WHEN starts_with(tag, 'US_') THEN 'us' ELSE 'lifestyle' END AS store,
           nullif(regexp_extract(body, 'Ms[0-9]+|#[0-9]+'), '') AS order_no, 'Customer' AS first_name
    FROM order_mail""", "order_mail"))
def order_numbers(spark: SparkSession, d: str) -> DataFrame:
    return V.order_mail(spark, d).select(
        "message_id", store_of(F.col("tag")).alias("store"), X.order_number(F.col("body")).alias("order_no"),
        X.first_name(F.col("sender")).alias("first_name"))


@query("""
    SELECT o_orderkey, CAST(o_orderdate AS DATE) + CASE isodow(o_orderdate) WHEN 4 THEN 4 WHEN 5 THEN 4 WHEN 6 THEN 3
             ELSE 2 END AS check_by, strftime(o_orderdate, '%B %d, %Y') AS placed,
           CAST(date_diff('day', o_orderdate, TIMESTAMP '2001-08-03') AS INTEGER) AS age
    FROM orders""")
def order_dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return V.read(spark, d, "orders").select(
        "o_orderkey", dates.add_business_days(day).alias("check_by"), dates.long_date(F.col("o_orderdate")).alias("placed"),
        dates.age_days(V.SHOP_NOW, day).alias("age"))


_MAPPED = "UNION ALL ".join(
    f"SELECT '{store}_{issue}' AS tag, {i} AS position, 'CANONICAL_skill_{skill}-{suffix}.md' AS filename "
    for store, suffix in (("US", "us"), ("LIFESTYLE", "intl"))
    for issue, skills in (
        ("WISMO", ["order-shipping"]), ("WARRANTY", ["warranty-claim"]), ("RETURN", ["return-processing"]),
        ("SHIPPING", ["order-shipping"]), ("ORDERMOD", ["order-modification"]), ("OOS", ["oos-notification"]),
        ("ADDRESS", ["address-verification", "order-modification"]))
    for i, skill in enumerate(skills))
_TAGS = ("US_WISMO", "LIFESTYLE_ADDRESS", "GENERAL_PRODUCT", "US_GENERAL", "US_OOS", "LIFESTYLE_RETURN", "B2B_FILTERED")
FILES = f"""
    SELECT message_id, coalesce(position, 0) AS position, coalesce(filename, CASE WHEN contains(tag, 'GENERAL') THEN
        CASE WHEN inf AND model = 17 THEN 'CANONICAL_skill_product-support-influence-iphone17.md'
             WHEN inf AND model = 16 THEN 'CANONICAL_skill_product-support-influence-iphone16.md'
             WHEN inf AND model BETWEEN 12 AND 15 THEN 'CANONICAL_skill_product-support-influence-iphone12-15.md'
             WHEN NOT inf AND proof AND model BETWEEN 11 AND 16 THEN 'CANONICAL_skill_product-support-waterproof-iphone.md' END END)
        AS filename
    FROM (SELECT message_id, {pick('doc_id', _TAGS)} AS tag, contains(lower(coalesce(body, '')), 'influence') AS inf,
            contains(lower(coalesce(body, '')), 'waterproof') AS proof,
            TRY_CAST(nullif(regexp_extract(lower(coalesce(body, '')), 'iphone\\s*([0-9][0-9])', 1), '') AS INT) AS model
          FROM inbox) LEFT JOIN mapped USING (tag)"""
FILE_TABLES = {"mapped": _MAPPED, "files": FILES}


def _files(spark: SparkSession, d: str) -> DataFrame:
    return drafting.kb_files_for(V.inbox(spark, d).withColumn("tag", V.pick(F.col("doc_id"), _TAGS)))


@query(with_tables("SELECT message_id, position, filename FROM files", "inbox", extra=FILE_TABLES))
def kb_files_for(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("message_id", "position", "filename")


@query(with_tables("SELECT message_id, position, filename FROM files", "inbox", extra=FILE_TABLES))
def kb_files_from_table(spark: SparkSession, d: str) -> DataFrame:
    mail = V.inbox(spark, d).withColumn("tag", V.pick(F.col("doc_id"), _TAGS))
    return drafting.kb_files_for(mail, drafting.kb_mapping(spark)).select("message_id", "position", "filename")


@query(with_tables("SELECT DISTINCT filename FROM files WHERE filename IS NOT NULL", "inbox", extra=FILE_TABLES))
def needed_files(spark: SparkSession, d: str) -> DataFrame:
    return drafting.needed_files(_files(spark, d))


# Contents of the needed files: what all documents of a language come to.
_KEPT = {"CANONICAL_skill_order-shipping-us.md": ("fr", "primary", 2), "CANONICAL_skill_oos-notification-us.md": ("de", "mirror", 3),
         "CANONICAL_skill_return-processing-intl.md": ("en", "cache", 1), "CANONICAL_skill_warranty-claim-us.md": ("es", "primary", 2)}
_DIGESTS = "count(*) || ' documents of ' || sum(length(text)) || ' letters from ' || min(md5(text)) || ' to ' || max(md5(text))"
CONTENTS = " UNION ALL ".join(
    f"SELECT '{name}' AS filename, '{source}' AS source, {_DIGESTS} AS content FROM documents WHERE lang = '{lang}'"
    for name, (lang, source, _) in _KEPT.items())


@query(with_tables("""
    SELECT message_id, position, f.filename, md5(content) AS content, c.source AS kb_source,
           f.filename IS NOT NULL AND c.filename IS NULL AS kb_unavailable
    FROM files f LEFT JOIN contents c ON c.filename = f.filename""", "inbox", extra={**FILE_TABLES, "contents": CONTENTS}))
def attach_kb(spark: SparkSession, d: str) -> DataFrame:
    """Messages with the text of their files, which together name all documents."""
    texts = V.read(spark, d, "documents").groupBy("lang").agg(V.summary("text").alias("content"))
    place = F.create_map(*[F.lit(x) for name, (lang, source, priority) in _KEPT.items() for x in (lang, F.struct(F.lit(name).alias("filename"), F.lit(source).alias("source"), F.lit(priority).alias("priority")))])
    candidates = texts.select(place[F.col("lang")].alias("k"), "content").select("k.*", "content", F.lit(None).cast("timestamp").alias("cached_at"))
    files = _files(spark, d)
    contents = scans.resolve_source(drafting.needed_files(files), candidates, V.MAIL_NOW)
    rows = drafting.attach_kb(files, contents)
    found = F.when(F.col("content").isNotNull(), F.col("kb_source")).alias("kb_source")
    return rows.select("message_id", "position", "filename", F.md5("content").alias("content"), found, "kb_unavailable")


@query("""
    WITH c AS (
        SELECT doc_id, 'cache' AS source, 1 AS priority, md5(text) AS content
        FROM labels JOIN documents USING (doc_id) WHERE doc_id % 48 < 24
        UNION ALL SELECT doc_id, 'primary', 2, md5(text) FROM documents WHERE lang IN ('en', 'fr')
        UNION ALL SELECT doc_id, 'mirror', 3, md5(text) FROM documents WHERE lang = 'de')
    SELECT doc_id, coalesce(arg_min(c.source, priority), 'UNAVAILABLE') AS source, arg_min(content, priority) AS content
    FROM documents LEFT JOIN c USING (doc_id) GROUP BY 1""")
def resolve_source(spark: SparkSession, d: str) -> DataFrame:
    docs = V.read(spark, d, "documents").withColumn("content", F.md5("text"))
    cached = docs.join(V.read(spark, d, "labels").select("doc_id"), "doc_id")
    none = F.lit(None).cast("timestamp")

    def source(rows: DataFrame, name: str, priority: int, cached_at) -> DataFrame:
        return rows.select("doc_id", F.lit(name).alias("source"), F.lit(priority).alias("priority"), "content",
                           cached_at.alias("cached_at"))

    age = F.make_dt_interval(hours=(F.col("doc_id") % 48).cast("int"))
    candidates = (
        source(cached, "cache", 1, dates.moment(V.MAIL_NOW) - age)
        .unionByName(source(docs.filter(F.col("lang").isin("en", "fr")), "primary", 2, none))
        .unionByName(source(docs.filter(F.col("lang") == "de"), "mirror", 3, none)))
    return scans.resolve_source(docs, candidates, V.MAIL_NOW, key="doc_id")


@query("""
    SELECT event_type AS label_name, min(user_id) AS label_id FROM events
    WHERE ts > TIMESTAMP '2024-01-29 12:00:00' AND ts = (SELECT max(ts) FROM events) GROUP BY 1""")
def label_snapshot(spark: SparkSession, d: str) -> DataFrame:
    snapshots = V.read(spark, d, "events").select(
        F.col("ts").cast("timestamp").alias("cached_at"), F.col("event_type").alias("label_name"),
        F.col("user_id").alias("label_id"))
    return scans.label_snapshot(snapshots, "2024-01-30 12:00:00")


_PHRASES = sorted(W.BANNED_PHRASES)


@query(with_tables(f"""
    SELECT message_id, CAST(words AS INTEGER) AS word_count, array_to_string(list_concat(
        list_sort(list_filter([{', '.join(map(text, _PHRASES))}],
            lambda p: regexp_matches(lower(t), '(^|[^0-9a-z_])' || p || '([^0-9a-z_]|$)'))),
        list_filter([CASE WHEN regexp_matches(t, '(?is)\\bnot only\\b.*\\bbut also\\b') THEN 'not only ... but also' END,
            CASE WHEN contains(t, '—') THEN 'em dash' END, CASE WHEN regexp_matches(t, '\\bI\\b') THEN 'first person' END,
            CASE WHEN words < 150 THEN 'too short' END, CASE WHEN words > 250 THEN 'too long' END],
            lambda x: x IS NOT NULL)), '|') AS violations
    FROM (SELECT message_id, {pick('conv_id', V.DRAFT_LEADS)} || body AS t,
            len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) AS words FROM messages)""", "messages"))
def lint_drafts(spark: SparkSession, d: str) -> DataFrame:
    rows = V.messages(spark, d).withColumn("draft_text", F.concat(V.pick(F.col("conv_id"), V.DRAFT_LEADS), F.col("body")))
    return drafting.lint_drafts(rows).select("message_id", "word_count", F.array_join("violations", "|").alias("violations"))


CUES = f"""
    SELECT *, CASE WHEN urgent THEN 'URGENT' WHEN shouting OR threat THEN 'ANGRY' WHEN contact_no >= 2 THEN 'FRUSTRATED'
            ELSE 'NEUTRAL' END AS sentiment,
        CASE WHEN threat OR contact_no >= 3 THEN 'HIGH' WHEN contact_no = 2 OR shouting THEN 'MEDIUM' ELSE 'LOW' END
            AS escalation_risk
    FROM (SELECT message_id, coalesce(body, '') AS t,
            regexp_matches(lower(t), '(^|[^0-9a-z_])({'|'.join(W.URGENT_WORDS)})([^0-9a-z_]|$)') AS urgent,
            len(regexp_extract_all(t, '\\b[A-Z][A-Z][A-Z]+\\b')) >= 3 OR contains(t, '!!') AS shouting,
            regexp_matches(lower(t), '(^|[^0-9a-z_])({'|'.join(W.THREAT_WORDS)})([^0-9a-z_]|$)') AS threat,
            row_number() OVER (PARTITION BY thread_id ORDER BY received_at, message_id) AS contact_no
          FROM inbox)"""


def _cues(spark: SparkSession, d: str) -> DataFrame:
    return drafting.cue_features(T.contact_index(V.inbox(spark, d), F.lit(True)))


@query(with_tables("SELECT message_id, urgent, shouting, threat, contact_no, sentiment, escalation_risk FROM cues",
                   "inbox", extra={"cues": CUES}))
def cue_features(spark: SparkSession, d: str) -> DataFrame:
    return _cues(spark, d).select(
        "message_id", "urgent", "shouting", "threat", "contact_no", "sentiment", "escalation_risk")


@query(with_tables(f"""
    SELECT message_id, CASE sentiment WHEN 'ANGRY' THEN 'empathy' WHEN 'FRUSTRATED' THEN 'empathy'
             WHEN 'URGENT' THEN 'resolution_first' ELSE 'standard' END AS tone,
           md5(t || CASE WHEN escalation_risk = 'HIGH' THEN {NL} ||
             '[⚠️ ESCALATION_RISK: HIGH — priority human review before sending]' ELSE '' END) AS draft
    FROM cues""", "inbox", extra={"cues": CUES}))
def tone_and_risk_line(spark: SparkSession, d: str) -> DataFrame:
    rows = drafting.tone(_cues(spark, d).withColumn("draft_text", X.text_or_empty(F.col("body"))))
    return drafting.add_risk_line(rows).select("message_id", "tone", F.md5("draft_text").alias("draft"))


@query("""
    SELECT p_partkey, 2 AS n_headers, p_brand AS subject, p_type AS date FROM part""")
def header_map(spark: SparkSession, d: str) -> DataFrame:
    def header(name: str, col: str) -> Column:
        return F.struct(F.lit(name).alias("name"), F.col(col).alias("value"))

    headers = F.array(header("Subject", "p_name"), header("DATE", "p_type"), header("subject", "p_brand"))
    return V.read(spark, d, "part").withColumn("h", scans.header_map(headers)).select(
        "p_partkey", F.size("h").alias("n_headers"), F.col("h")["subject"].alias("subject"), F.col("h")["date"].alias("date"))


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def json_array_from_text(spark: SparkSession, d: str) -> DataFrame:
    printed = V.read(spark, d, "conversations").select(
        "conv_id", F.concat(
            F.lit("Found these:\n"), F.to_json(F.array(F.struct("turn", "role", "text"))), F.lit("\nDone.")).alias("out"))
    rows = scans.json_array_from_text(printed, "out", "turn:bigint,role:string,text:string")
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


def _staged_lines(spark: SparkSession, d: str) -> DataFrame:
    """Staging lines: each draft as JSON, with blank, broken, bare and incomplete lines between them."""
    m = V.messages(spark, d)
    record = F.struct(
        F.when(F.col("role") != "system", F.col("message_id")).alias("draft_id"), "thread_id",
        F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.col("body").alias("draft_text"),
        F.lit("RECONCILED").alias("status"))
    return m.select(F.explode(F.array(
        F.to_json(record), F.lit("  "), F.concat(F.lit("{bad "), F.col("message_id")), F.lit("[1, 2]"))).alias("value"))


@query(with_tables("""
    SELECT message_id AS draft_id, thread_id, received_at AS created_at, md5(body) AS digest, 'PENDING' AS status,
           CAST(NULL AS VARCHAR) AS secondary_intent
    FROM messages WHERE role <> 'system'""", "messages"))
def flush_staging(spark: SparkSession, d: str) -> DataFrame:
    staged, _ = staging.parse_staging(_staged_lines(spark, d))
    rows, _, _ = staging.flush_staging(staged)
    return rows.select("draft_id", "thread_id", "created_at", F.md5("draft_text").alias("digest"), "status", "secondary_intent")


@query(with_tables("""
    SELECT (SELECT count(*) FROM messages WHERE role <> 'system') AS appended,
           (SELECT count(*) FROM messages WHERE role = 'system') AS failed,
           (SELECT 2 * count(*) FROM messages) AS unreadable""", "messages"))
def staging_counts(spark: SparkSession, d: str) -> DataFrame:
    staged, rejects = staging.parse_staging(_staged_lines(spark, d))
    _, _, stats = staging.flush_staging(staged)
    return stats.withColumn("unreadable", rejects.agg(F.count(F.lit(1))).scalar())


@query("SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM documents")
def mime_body(spark: SparkSession, d: str) -> DataFrame:
    """Payload trees of four shapes around each document: single part, plain first, nested, attachment first."""
    def part(kind: str, data) -> Column:
        return F.concat(F.lit(f'{{"mimeType":"{kind}","body":{{"data":"'), data, F.lit('"}}'))

    def tree(kind: str, *parts) -> Column:
        return F.concat(F.lit(f'{{"mimeType":"{kind}","parts":['), F.concat_ws(",", *parts), F.lit("]}"))

    raw = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "[\r\n]", "")
    data = F.rtrim(F.translate(raw, "+/", "-_"), F.lit("="))
    html = F.lit("PGI-eDwvYj4")
    shapes = F.array(
        part("text/html", data),
        tree("multipart/alternative", part("text/html", html), part("text/plain", data)),
        tree("multipart/mixed", tree("multipart/alternative", part("text/plain", data), part("text/html", html)),
             part("application/pdf", html)),
        tree("multipart/mixed", part("text/plain", F.lit("")), tree("multipart/related", part("text/html", data))))
    rows = V.read(spark, d, "documents").select(
        "doc_id", F.element_at(shapes, (F.col("doc_id") % 4 + 1).cast("int")).alias("payload"))
    return mime.with_mime_body(rows, "payload").select(
        "doc_id", F.length("body").alias("n_chars"), F.md5("body").alias("digest"))


@query(with_tables(f"""
    SELECT doc_id, md5(array_to_string(list_filter(string_split(coalesce(body, ''), {NL}),
             lambda l: NOT starts_with(ltrim(l, ' ' || chr(9)), '>')), {NL})) AS unquoted,
           regexp_matches(coalesce(body, ''), '[一-鿿]') AS cjk, left(coalesce(body, ''), 300) AS snippet
    FROM inbox""", "inbox"))
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    body = X.text_or_empty(F.col("body"))
    return V.inbox(spark, d).select(
        "doc_id", F.md5(X.strip_quoted(body)).alias("unquoted"), X.has_cjk(body).alias("cjk"),
        F.left(body, F.lit(300)).alias("snippet"))


@query(with_tables("SELECT draft_id, status, CAST(NULL AS VARCHAR) AS store, CAST(NULL AS VARCHAR) AS order_id FROM draft_log",
                   "draft_log"))
def schema_evolution(spark: SparkSession, d: str) -> DataFrame:
    return evolve(V.draft_log(spark, d), DRAFT_LOG).select("draft_id", "status", "store", "order_id")
