import random
import re

from hypothesis import HealthCheck, given, settings, strategies as st

from postmill.functions import rule_words as W
from postmill.operators import rules as R

B2B = "B2B_FILTERED"
CASES = [
    ("notifications@fillout.com", "Warranty Claim Form", "Ms14501", "R0", None),
    ("mailer@shopify.com", "any", "any", "R0.1", B2B),
    ("mailer@vanchat.io", "any", "invoice", "R0.2", None),
    ("service@paypal.com", "any", "unsubscribe", "R0.5", None),
    ("no_reply@x.com", "any", "any", "R1a", B2B),
    ("x@y.com", "Re: hello", "our agency", "R1b", B2B),
    ("x@y.com", "Re: hello", "reply immediately", "R1b", B2B),
    ("a@qq.com", "Re: hello", "our agency", "R1", B2B),
    ("noreply@x.com", "any", "any", "R1", B2B),
    ('"X" <noreply@x.com>', "hello", "hello", "R4", None),
    ("a@supplychain.amazon.com", "hello", "hello", "R1", B2B),
    ("x@y.com", "你好", "hello", "R1.5", B2B),
    ("x@y.com", "hello", "你好", "R4", None),
    ("x@y.com", "20% off", "hello", "R1.5", B2B),
    ("x@y.com", "hello", "join our webinar", "R2", B2B),
    ("x@y.com", "hello", "> see webinar", "R2", B2B),
    ("x@y.com", "my claim", "thanks\n> see invoice", "R4", None),
    ("x@y.com", "my claim", "thanks\n\t> see invoice", "R4", None),
    ("x@y.com", "my claim", "see invoice", "R3", B2B),
    ("x@y.com", "a trade", "show", "R2", B2B),
    ("x@y.com", None, None, "R4", None),
    (None, "hello", "hello", "R4", None),
]
SCHEMA = "sender string, subject string, body string"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {SCHEMA}")


def test_prefilter_cases(spark):
    got = R.prefilter(frame(spark, [c[:3] for c in CASES])).orderBy("i").select("rule_id", "tag").collect()
    assert [tuple(r) for r in got] == [c[3:] for c in CASES]


def test_rules_as_data_agree(spark):
    rules = spark.createDataFrame(R.default_rule_rows(), R.RULE_TABLE)
    got = R.classify_with_rules(frame(spark, [c[:3] for c in CASES]), rules).orderBy("i").select("rule_id", "tag").collect()
    assert [tuple(r) for r in got] == [c[3:] for c in CASES]


def test_triage_cases(spark):
    cases = [
        ("x@y.com", "q", "where is my order Ms123", "US_WISMO"),
        ("x@y.com", "q", "where is my order #12", "LIFESTYLE_WISMO"),
        ("x@y.com", "q", "where is my order", None),
        ("x@y.com", "q", "where is my order ms123", None),
        ("s@paypal.com", "q", "dispute", "US_CHARGEBACK"),
        ("s@paypal.com", "q", "dispute hk", "LIFESTYLE_CHARGEBACK"),
        ("s@paypal.com", "q", "thanks", B2B),
        ("s@amazon.com", "q", "dispute hk", "US_CHARGEBACK"),
        ("s@amazon.com", "q", "dispute lifestyle", "LIFESTYLE_CHARGEBACK"),
        ("notifications@fillout.com", "Warranty Claim Form", "Ms1 #2", "US_WARRANTY"),
        ("notifications@fillout.com", "Warranty Claim Form", "#2", "LIFESTYLE_WARRANTY"),
        ("notifications@fillout.com", "Warranty Claim Form", "overseas", "LIFESTYLE_WARRANTY"),
        ("notifications@fillout.com", "Warranty Claim Form", "x", "US_WARRANTY"),
        ("notifications@fillout.com", "Other", "x", None),
        ("mailer@vanchat.io", "q", "uptime alert", B2B),
        ("mailer@vanchat.io", "q", "alert about my order", None),
    ]
    got = R.triage(frame(spark, [c[:3] for c in cases])).orderBy("i").collect()
    assert [r["tag"] for r in got] == [c[3] for c in cases]
    assert all(r["needs_model"] == (r["tag"] is None) for r in got)


def test_options(spark):
    rows = frame(spark, [("x@y.com", "webinar", "hello"), ("x@y.com", "hi", "showcase " * 40 + "webinar"), ("x@y.com", "re: a", "immediately")])
    assert [r["rule_id"] for r in R.prefilter(rows, scan="body").orderBy("i").collect()] == ["R4", "R2", "R1b"]
    assert [r["rule_id"] for r in R.prefilter(rows, body_chars=300).orderBy("i").collect()] == ["R2", "R4", "R1b"]
    assert [r["rule_id"] for r in R.prefilter(rows, word_boundary=True).orderBy("i").collect()] == ["R2", "R2", "R4"]


def model(sender, subject, body):
    """The cascade in plain words, for bulk mail or not."""
    s, su, b = sender.lower(), subject.lower(), body.lower()

    def holds(text, words):
        return re.search("|".join(map(re.escape, words)), text) is not None

    if holds(s, [W.FORM_SENDER]):
        return "R0"
    if holds(s, W.SYSTEM_MAILERS):
        return "R0.1"
    if holds(s, [W.CHAT_RELAY]):
        return "R0.2"
    if holds(s, W.PAYMENT_SENDERS + W.MARKET_SENDERS):
        return "R0.5"
    if holds(s, W.POSTAL_SENDERS):
        return "R1a"
    listed = holds(s, W.B2B_DOMAINS + W.B2B_ADDRESSES)
    whole = f"{su} {b}"
    if su[:3] == "re:" and holds(whole, W.PITCH_WORDS) and not listed:
        return "R1b"
    if listed or s.startswith(W.BULK_PREFIXES):
        return "R1"
    if re.search("[一-鿿]", subject) or holds(su, W.PROMO_SUBJECTS):
        return "R1.5"
    if holds(whole, W.EVENT_WORDS):
        return "R2"
    kept = "\n".join(x for x in b.splitlines() if not x.strip().startswith(">"))
    return "R3" if holds(f"{su} {kept}", W.B2B_WORDS + W.PROMO_WORDS) else "R4"


pieces = st.lists(
    st.sampled_from(
        ["Re: ", "hello ", "media ", "invoice ", "\n> discount ", "\n", "你", "WEBINAR ", "trade", " show", "% off ", "é "]
    ), max_size=6,
).map("".join)
senders = st.sampled_from(
    ["x@y.com", "NoReply@x.com", "a@QQ.com", "ecship@z.com", "mailer@vanchat.io", "b@paypal.com", "notifications@fillout.com"]
)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(senders, pieces, pieces), min_size=60, max_size=60))
def test_cascade_equals_plain_model(spark, rows):
    got = R.prefilter(frame(spark, rows)).orderBy("i").select("rule_id").collect()
    assert [r["rule_id"] for r in got] == [model(*r) for r in rows]


def test_cascade_is_native_narrow_and_evaluated_once(spark, plan):
    from pyspark.sql import functions as F

    df = R.triage(frame(spark, [c[:3] for c in CASES])).filter(F.col("tag").isNotNull()).select("i", "tag")
    df.collect()
    text = plan(df)
    assert "Python" not in text and "Exchange" not in text
    assert text.count("pirateship") <= 1 or text.count("Generate") == 1


def test_model_reply(spark):
    replies = spark.createDataFrame(
        [('ok {"tag": "US_WISMO", "reason": "r"}',), ('{"tag": "X"}',), ("no json",), (None,)], "reply string"
    )
    got = [(r["tag"], r["rejected"]) for r in R.parse_model_reply(replies).collect()]
    assert got == [("US_WISMO", False), (None, True), (None, True), (None, True)]


def test_model_hook(spark):
    def classify(batches):
        for pdf in batches:
            yield pdf.assign(tag="GENERAL_PRODUCT")[["i", "tag"]]

    _, open_rows = R.split_for_model(R.triage(frame(spark, [c[:3] for c in CASES])))
    got = R.apply_model(open_rows, classify, "i int, tag string").collect()
    assert got and {r["tag"] for r in got} == {"GENERAL_PRODUCT"}


def test_many_rules_in_blocks_equal_walking_along_them(spark, monkeypatch):
    """Random literal rules, guards and regular expressions, in one block and in several, against the first that matches."""
    r = random.Random(4)
    bits = ["ab", "ba", "aab", "b b", "abba", "", "é", "c", "bab"]
    columns = ("sender", "subject", "content", "unquoted", "body")
    rules = [
        (r.randrange(20), f"r{k}", r.choice([None, "t1", "t2"]), r.choice(columns), r.choice(["contains", "starts", "regex", "odd"]), r.choice(bits) + r.choice(["", "c"]),
         *r.choice([(None, None, None), ("subject", "starts", "a"), ("sender", "regex", "b$"), ("body", "contains", "b")]))
        for k in range(60)
    ]
    texts = ["".join(r.choice("abc é") for _ in range(r.randrange(0, 9))) for _ in range(200)]
    messages = [(i, texts[i], texts[(7 * i + 1) % 200], texts[(3 * i + 2) % 200]) for i in range(200)]
    frame_ = spark.createDataFrame(messages, "i int, sender string, subject string, body string")

    def holds(f, op, p, m):
        fields = {"sender": m[1], "subject": m[2], "body": m[3], "content": f"{m[2]} {m[3]}", "unquoted": f"{m[2]} {m[3]}"}
        t = fields[f]
        return {"contains": p in t, "starts": t.startswith(p), "regex": re.search(p, t) is not None}.get(op, False)

    key = lambda rule: [(x is not None, x) for x in rule]
    want = {}
    for m in messages:
        hits = [x for x in rules if holds(*x[3:6], m) and (x[6] is None or holds(*x[6:], m))]
        best = min(hits, key=key, default=None)
        want[m[0]] = (best[1], best[2]) if best else ("R4", None)
    table = spark.createDataFrame(rules, R.RULE_TABLE)
    for size in (100_000, 17):
        monkeypatch.setattr(R, "RULES_AT_A_TIME", size)
        got = {x["i"]: (x["rule_id"], x["tag"]) for x in R.classify_with_rules(frame_, table).collect()}
        assert got == want


def test_hundred_thousand_rules(spark):
    """A message is read once, however many rules there are."""
    rules = spark.range(100_000).selectExpr(
        "cast(100000 - id as int) as priority", "concat('r', id) as rule_id", "'t' as tag", "'content' as field", "'contains' as op", "concat('key', id, 'end') as pattern",
        "cast(null as string) as guard_field", "cast(null as string) as guard_op", "cast(null as string) as guard_pattern")
    mail = spark.range(2000).selectExpr("cast(id as int) as i", "'a' as sender", "concat('x key', id * 7, 'end') as subject", "repeat('key12 filler ', 50) as body")
    got = {r["i"]: r["rule_id"] for r in R.classify_with_rules(mail, rules).collect()}
    assert got == {i: f"r{i * 7}" for i in range(2000)}


def test_only_the_fields_of_the_rules_are_sent_and_none_comes_back(spark, plan):
    """Copies of the text that no rule reads would fill Python's memory with each batch."""
    rules = spark.createDataFrame([(1, "r", "t", "subject", "contains", "x", None, None, None)], R.RULE_TABLE)
    mail = spark.createDataFrame([("m", "a", "x", "some text")], "message_id string, sender string, subject string, body string")
    got = R.classify_with_rules(mail, rules)
    step = next(line for line in plan(got).splitlines() if "MapInArrow" in line)
    assert not any(f"{field}#" in step for field in ("_content", "_unquoted", "_body", "_raw_body", "_sender"))
    assert got.columns == ["message_id", "sender", "subject", "body", "rule_id", "tag"] and got.first()["tag"] == "t"


def test_texts_of_a_batch_are_held_one_at_a_time():
    """Of 200 messages of 1 MB each, no more than a few are Python's strings at once."""
    import tracemalloc

    import pyarrow as pa

    n = 200
    kind = pa.struct([(c, pa.int32() if c == "priority" else pa.string()) for c in R.RULE_COLUMNS])
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["word " * 200_000] * n), pa.array([[]] * n, pa.list_(pa.bool_())), pa.nulls(n, kind)], ["_content", "_regex", "_hit"])
    step = R._matcher([(1, "r", "t", "content", "contains", "absent", None, None, None)], [], ["content"], ["_hit"])
    tracemalloc.start()
    assert [b.num_rows for b in step(iter([batch]))] == [n]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20_000_000
