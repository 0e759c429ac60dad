import base64
import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from postmill.schemas import ACCURACY_LOG, DRAFT_LOG, evolve
from postmill.sources import files, mime, scans, staging

NOW = datetime(2024, 3, 8, 12)


def b64(text, pad=True):
    out = base64.urlsafe_b64encode(text if isinstance(text, bytes) else text.encode()).decode()
    return out if pad else out.rstrip("=")


def part(kind, text, pad=True):
    return {"mimeType": kind, "body": {"data": b64(text, pad)}}


def test_mime_bodies(spark):
    deep = {"mimeType": "multipart/mixed", "parts": [
        {"mimeType": "multipart/related", "parts": [{"mimeType": "multipart/alternative", "parts": [part("text/html", "<b>"), part("text/plain", "deep")]}]},
        part("text/plain", "")]}
    cases = [
        (part("text/html", "<p>leaf</p>"), "<p>leaf</p>"),
        ({"mimeType": "m", "parts": [part("text/html", "<b>"), part("text/plain", "plain é?>", pad=False)]}, "plain é?>"),
        ({"mimeType": "m", "parts": [part("text/plain", ""), part("text/plain", "second")]}, "second"),
        ({"mimeType": "m", "parts": [part("text/html", "<i>x</i>")]}, "<i>x</i>"),
        (deep, "deep"),
        ({"mimeType": "m", "parts": [{"mimeType": "x", "parts": []}, {"mimeType": "y"}]}, ""),
        ({"mimeType": "text/plain"}, ""),
        (part("text/plain", b"bad \xff byte"), "bad � byte"),
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, payload string")
    got = [r["body"] for r in mime.with_mime_body(df, "payload").orderBy("i").collect()]
    assert got == [w for _, w in cases]


def test_staging_lines(spark, tmp_path):
    good = {"draft_id": "d1", "created_at": "2024-03-01T10:00:00Z", "status": "RECONCILED", "draft_text": "x"}
    lines = [json.dumps(good), "", "   ", "{bad json", "[1]", "5", '"text"', json.dumps({**good, "draft_id": None}),
             json.dumps({**good, "draft_id": "d2", "created_at": "soon"})]
    (tmp_path / "s.jsonl").write_text("\n".join(lines))
    rows, rejects = staging.read_staging(spark, str(tmp_path))
    assert sorted(r["value"] for r in rejects.collect()) == sorted(["{bad json", "[1]", "5", '"text"'])
    fresh, bad, stats = staging.flush_staging(rows)
    row = fresh.collect()
    assert [(r["draft_id"], r["status"], r["created_at"], r["secondary_intent"]) for r in row] == [
        ("d1", "PENDING", datetime(2024, 3, 1, 10), None)]
    assert fresh.columns == [f.name for f in DRAFT_LOG.fields]
    assert sorted(r["reason"] for r in bad.collect()) == ["created_at unreadable", "draft_id missing"]
    assert tuple(stats.first()) == (1, 2)
    assert staging.unseen(fresh, fresh).count() == 0


def test_source_order_and_freshness(spark):
    rows = [("f1", "cache", 1, "c", NOW - timedelta(hours=23)), ("f1", "primary", 2, "p", None),
            ("f2", "cache", 1, "c", NOW - timedelta(hours=24)), ("f2", "primary", 2, "p", None),
            ("f3", "primary", 2, None, None), ("f3", "mirror", 3, "m", None)]
    cands = spark.createDataFrame(rows, "filename string, source string, priority int, content string, cached_at timestamp")
    keys = spark.createDataFrame([("f1",), ("f2",), ("f3",), ("f4",), ("f4",)], "filename string")
    got = {r["filename"]: (r["source"], r["content"]) for r in scans.resolve_source(keys, cands, NOW).collect()}
    assert got == {"f1": ("cache", "c"), "f2": ("primary", "p"), "f3": ("mirror", "m"), "f4": ("UNAVAILABLE", None)}


def test_headers_and_json_array(spark):
    df = spark.createDataFrame([([("Subject", "a"), ("subject", "b"), ("Date", "d")],)], "h array<struct<name:string,value:string>>")
    row = df.select(scans.header_map(F.col("h")).alias("m"), scans.header_value(F.col("h"), "subject").alias("s")).first()
    assert row["m"] == {"subject": "b", "date": "d"} and row["s"] == "b"
    out = spark.createDataFrame([('x [{"id":"1","n":[2]},\n{"id":"3"}] y',), ("nothing",)], "o string")
    assert [r["id"] for r in scans.json_array_from_text(out, "o", "id:string").collect()] == ["1", "3"]


def test_evolve_is_idempotent(spark):
    df = spark.createDataFrame([("d", 5)], "draft_id string, edit_distance int")
    once = evolve(df, ACCURACY_LOG)
    assert set(once.columns) == {f.name for f in ACCURACY_LOG.fields} and evolve(once, ACCURACY_LOG).columns == once.columns
    assert once.first()["thread_id"] is None


def test_report_files(spark, tmp_path):
    report = spark.createDataFrame([(2, "b"), (1, "a")], "line_no int, line string")
    files.write_report(report, str(tmp_path), "2024-03-04")
    files.write_report(report, str(tmp_path), "2024-03-11")
    for name in ("date=2024-03-04", "date=2024-03-11", "latest"):
        assert [r["value"] for r in spark.read.text(f"{tmp_path}/{name}").collect()] == ["a", "b"]


def test_kb_files_and_context(spark, tmp_path):
    (tmp_path / "CANONICAL_skill_a-us.md").write_text("one\ntwo")
    (tmp_path / "notes.md").write_text("no")
    assert [tuple(r) for r in files.read_kb(spark, str(tmp_path)).collect()] == [("CANONICAL_skill_a-us.md", "one\ntwo")]
    (tmp_path / "CANONICAL_skill_0.md").write_text("x")
    assert [r["filename"] for r in files.read_kb(spark, str(tmp_path), ordered=True).collect()] == ["CANONICAL_skill_0.md", "CANONICAL_skill_a-us.md"]
    files.write_context(spark.createDataFrame([("q", [1])], "query_id string, matches array<int>"), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").first()["query_id"] == "q"


def test_nested_mime_bodies_are_read_without_python(spark, monkeypatch):
    """To four levels of parts; what lies deeper goes to Python and gives the same."""
    def nest(node, levels):
        return node if not levels else {"mimeType": "multipart/mixed", "parts": [part("application/pdf", ""), nest(node, levels - 1), part("text/html", "<late>")]}

    odd = [
        {"mimeType": "m", "parts": [{"mimeType": "x", "parts": [{"mimeType": "text/plain", "body": {"data": "="}}, part("text/html", "no")]}, part("text/html", "<b>")]},
        {"mimeType": "m", "parts": [{"mimeType": "x", "body": {"data": "aGk"}, "parts": [part("text/html", "inner")]}]},
        {"mimeType": "m", "parts": [{"mimeType": "x", "parts": [{"mimeType": "text/html", "body": {"data": "aGVs\n\n\n\nbG8"}}]}]},
    ]
    trees = [nest(part(kind, f"text é {n}"), n) for kind in ("text/plain", "text/html") for n in range(8)] + odd
    want = [mime._first_text(t) for t in trees]
    frame = lambda some: spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(some)], "i int, payload string")
    assert [r["body"] for r in mime.with_mime_body(frame(trees), "payload").orderBy("i").collect()] == want

    @F.pandas_udf("string")
    def none(payload):
        assert payload.isna().all(), "sent to Python"
        return payload

    monkeypatch.setattr(mime, "_nested_text", none)
    shallow = [t for n in (0, 8) for t in trees[n : n + 5]]
    got = [r["body"] for r in mime.with_mime_body(frame(shallow), "payload").orderBy("i").collect()]
    assert got == [mime._first_text(t) for t in shallow]
