"""SQL forms of the derived tables, and helpers to write check queries with them.

The check queries are written for DuckDB on their own, not generated from the DataFrame
code; only word lists and literal rows are shared.
"""

from __future__ import annotations

from . import views as V

# Characters beyond ASCII that occur in the conversations. DuckDB's edit distance counts
# bytes, so each is replaced by a control character of one byte before comparing.
WIDE = "óéñèüäöíßêçÉÑÈÜÄÖÓÊÍÇ"
NARROW = [c for c in range(1, 32) if c not in (9, 10, 11, 12, 13)][: len(WIDE)]


def text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def one_byte(expr: str) -> str:
    return f"translate({expr}, '{WIDE}', {' || '.join(f'chr({c})' for c in NARROW)})"


def pick(key: str, values) -> str:
    return f"([{', '.join(text(v) for v in values)}])[({key}) % {len(values)} + 1]"


def any_of(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {text(w)})" for w in words) + ")"


def starts(expr: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({expr}, {text(w)})" for w in words) + ")"


def has(labels: str, names) -> str:
    return f"list_has_any({labels}, [{', '.join(text(n) for n in names)}])"


def at(seconds: str) -> str:
    return f"(TIMESTAMP '2024-01-01 00:00:00' + to_seconds({seconds}))"


_senders, _subjects, _leads = zip(*V.INBOX_CASES)

TABLES: dict[str, str] = {
    "messages": f"""
        SELECT 'M' || conv_id || '-' || turn AS message_id, 'T' || conv_id AS thread_id,
               {at('conv_id * 7 % 720 * 3600 + turn * 2100')} AS received_at,
               CASE role WHEN 'assistant' THEN 'Support <{V.AGENT}>' WHEN 'system' THEN 'noreply@mail.example'
                    ELSE 'user' || (conv_id % 50) || '@mail.example' END AS sender,
               text AS body, string_split({pick('conv_id + turn', V.LABEL_CASES)}, ',') AS labels,
               turn % 2 = 0 AS is_unread, role, conv_id, turn
        FROM conversations""",
    "inbox": f"""
        SELECT 'I' || doc_id AS message_id, 'T' || (doc_id % 97) AS thread_id,
               {at('doc_id * 6151 % 2592000')} AS received_at,
               {pick('doc_id', _senders)} AS sender, {pick('doc_id', _subjects)} AS subject,
               {pick('doc_id', _leads)} || text AS body,
               string_split({pick('doc_id', V.LABEL_CASES)}, ',') AS labels, doc_id % 3 <> 0 AS is_unread, doc_id
        FROM documents""",
    "drafts": f"""
        SELECT 'D' || conv_id || '-' || turn AS draft_id, thread_id, message_id, received_at AS created_at,
               {pick('conv_id', V.CATEGORIES)} AS email_category, body AS draft_text, conv_id, turn
        FROM messages WHERE role = 'assistant'""",
    "sent": """
        SELECT thread_id, 'S' || conv_id || '-' || turn AS message_id,
               CASE conv_id % 5 WHEN 0 THEN draft_text WHEN 1 THEN draft_text || ' Thanks.'
                    WHEN 2 THEN replace(draft_text, 'e', 'a')
                    WHEN 3 THEN 'Dear customer, ' || replace(draft_text, ' ', '')
                    ELSE reverse(draft_text) END AS body,
               created_at + INTERVAL 10 MINUTE AS sent_at, conv_id, turn
        FROM drafts WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""",
    "draft_log": f"""
        SELECT 'D' || o_orderkey AS draft_id,
               nullif({pick('o_orderkey', V.CATEGORIES)}, 'GENERAL_COMPATIBILITY') AS email_category,
               CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'F' THEN 'RECONCILED' ELSE 'ABANDONED' END AS status,
               CAST(o_orderdate AS TIMESTAMP) AS created_at,
               (['POSITIVE','NEUTRAL','FRUSTRATED','ANGRY','URGENT'])[CAST(left(o_orderpriority, 1) AS INT)] AS sentiment,
               {pick('o_custkey', V.INTENTS)} AS primary_intent, {pick('o_custkey', V.RISKS)} AS escalation_risk
        FROM orders""",
    "accuracy_raw": """
        SELECT 'D' || l_orderkey AS draft_id, CAST(l_shipdate AS TIMESTAMP) AS reconciled_at,
               CASE WHEN l_orderkey % 7 = 2 THEN round(l_discount * 10, 4)
                    ELSE round(l_discount * l_quantity * 20, 4) END AS edit_pct
        FROM lineitem""",
    "accuracy_log": """
        SELECT *, round(greatest(0, least(100, 100 - edit_pct)), 4) AS accuracy_score,
               CASE WHEN edit_pct = 0 THEN 'PERFECT' WHEN edit_pct < 5 THEN 'MINOR_EDIT'
                    WHEN edit_pct <= 50 THEN 'MAJOR_EDIT' ELSE 'REWRITE' END AS result
        FROM accuracy_raw""",
    "shipped": "SELECT l_orderkey, CAST(max(l_shipdate) AS TIMESTAMP) AS fulfilled_at FROM lineitem GROUP BY 1",
    "shop_orders": """
        SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'us' ELSE 'lifestyle' END AS store,
               CASE WHEN o_orderkey % 2 = 0 THEN 'Ms' ELSE '#' END || o_orderkey AS order_no,
               CAST(o_orderdate AS TIMESTAMP) AS created_at,
               CASE WHEN fulfilled_at IS NOT NULL THEN 'fulfilled' ELSE 'unfulfilled' END AS fulfillment_status,
               CASE WHEN fulfilled_at IS NOT NULL AND o_orderkey % 3 <> 0
                    THEN 'https://track.example/' || o_orderkey END AS tracking_url,
               CASE WHEN fulfilled_at IS NOT NULL THEN (['UPS', 'DHL', NULL])[o_orderkey % 3 + 1] END AS carrier,
               fulfilled_at,
               CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'in_transit' END AS shipment_status,
               CASE WHEN o_orderkey % 5 <> 0 THEN CAST(fulfilled_at AS DATE) + 5 END AS estimated_delivery_date,
               CASE WHEN o_orderstatus = 'F' THEN fulfilled_at + INTERVAL 3 DAY END AS delivered_at
        FROM orders LEFT JOIN shipped ON l_orderkey = o_orderkey""",
    "order_mail": """
        SELECT 'Q' || o_orderkey AS message_id, 'Customer ' || o_custkey || ' <c@mail.example>' AS sender,
               'Hello, where is my order ' || CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE
                 CASE WHEN o_orderkey % 2 = 0 THEN 'Ms' ELSE '#' END ||
                 CASE WHEN o_orderkey % 10 = 9 THEN o_orderkey + 100000000 ELSE o_orderkey END END
               || '? Thanks.' AS body,
               CASE WHEN o_orderkey % 2 = 0 THEN 'US_WISMO' ELSE 'LIFESTYLE_WISMO' END AS tag,
               ['AI_PROCESSED', CASE WHEN o_orderkey % 2 = 0 THEN 'US_WISMO' ELSE 'LIFESTYLE_WISMO' END] AS labels
        FROM orders""",
    "entries": """
        SELECT vec_id AS kb_id, label AS category, text, CAST(embedding AS DOUBLE[]) AS vector
        FROM embeddings JOIN documents ON vec_id = doc_id""",
    "articles": "SELECT doc_id AS kb_id, source AS category, text FROM documents",
    "questions": """
        SELECT message_id AS query_id, 'src' || (conv_id % 20) AS category, body AS text FROM messages""",
    "hashed_articles": r"""
        SELECT doc_id, source || '.md' AS filename, doc_id AS position, lang AS canonical_question,
               text AS canonical_answer,
               sha256(lang || '|' || regexp_replace(text, '^\s+|\s+$', '', 'g')) AS content_hash
        FROM documents""",
    "user_events": f"""
        SELECT 'E' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS message_id, 'U' || user_id AS thread_id,
               CAST(ts AS TIMESTAMP) AS received_at,
               CASE WHEN event_type = 'purchase' THEN '{V.AGENT}' ELSE 'user@mail.example' END AS sender,
               props AS body, event_type, value AS accuracy_score
        FROM events""",
}
NEEDS = {
    "drafts": ("messages",), "sent": ("drafts",), "accuracy_log": ("accuracy_raw",), "shop_orders": ("shipped",),
    "questions": ("messages",),
}


def with_tables(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind the derived tables it names and those they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in NEEDS.get(name, ()):
            visit(needed)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({TABLES[n].strip()})" for n in order]
    parts += [f"{n} AS ({q.strip()})" for n, q in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body.strip()}" if parts else body.strip()


# ---- the default embedding in SQL: terms fall into 256 places by the low bits of a 32-bit Murmur3 hash

_MASK = 4294967295


def _times(x: str, factor: int) -> str:
    return f"CAST((CAST({x} AS HUGEINT) * {factor}) % 4294967296 AS BIGINT)"


def _rotated(x: str, by: int) -> str:
    return f"(((({x}) << {by}) | (({x}) >> {32 - by})) & {_MASK})"


def _mixed(k: str) -> str:
    return _times(_rotated(_times(k, 0xCC9E2D51), 15), 0x1B873593)


def hashed_terms(words: str) -> dict[str, str]:
    """Tables that give ``term_places`` (term, place) for the distinct ``term`` of the table ``words``."""
    at = lambda i: f"b[{i}]"
    step = "list_reduce(list_prepend(42, blocks), lambda h, k: " + f"({_times(_rotated('xor(h, k)', 13), 5)} + 3864292196) & {_MASK})"
    return {
        "term_bytes": f"SELECT term, list_transform(range(octet_length(encode(term))), lambda i: CAST('0x' || substr(hex(encode(term)), 2 * i + 1, 2) AS BIGINT)) AS b "
                      f"FROM (SELECT DISTINCT term FROM {words})",
        "term_blocks": f"SELECT term, len(b) AS n, list_transform(list_transform(range(len(b) // 4), lambda i: {at('4*i+1')} | ({at('4*i+2')} << 8) | ({at('4*i+3')} << 16) | ({at('4*i+4')} << 24)), "
                       f"lambda k: {_mixed('k')}) AS blocks, coalesce(list_sum(list_transform(range(len(b) % 4), lambda i: b[len(b) // 4 * 4 + i + 1] << (8 * i))), 0) AS tail FROM term_bytes",
        "term_sums": f"SELECT term, n, {step} AS h, CAST(tail AS BIGINT) AS tail FROM term_blocks",
        "term_ends": f"SELECT term, xor(CASE WHEN n % 4 > 0 THEN xor(h, {_mixed('tail')}) ELSE h END, n) AS h FROM term_sums",
        "term_halves": f"SELECT term, {_times('xor(h, h >> 16)', 0x85EBCA6B)} AS h FROM term_ends",
        "term_last": f"SELECT term, {_times('xor(h, h >> 13)', 0xC2B2AE35)} AS h FROM term_halves",
        "term_places": "SELECT term, xor(h, h >> 16) & 255 AS place FROM term_last",
    }


def embedded(rows: str, key: str, text: str, words: str) -> dict[str, str]:
    """Tables up to ``digests`` (key, digest): the vector's values, each times its place, added up, of every row of ``rows`` with a word."""
    return {
        "embedded_terms": f"SELECT {key}, unnest({words.replace('text', text)}) AS term FROM {rows}",
        **hashed_terms("embedded_terms"),
        "digests": f"SELECT {key}, round(sum(n * (place + 1)) / sqrt(sum(n * n)), 6) AS digest FROM "
                   f"(SELECT {key}, place, count(*) AS n FROM embedded_terms JOIN term_places USING (term) GROUP BY 1, 2) GROUP BY 1",
    }
