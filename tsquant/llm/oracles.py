"""SQL of the queries that SQL can express, for DuckDB over the same tables.

Written from the contracts, not from the operators: matches come from plain patterns,
similarities from joins of all shingles or all vectors, components from reachability.
"""

from __future__ import annotations


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _spans(kind: str, rank: int, pattern: str, condition: str) -> str:
    """Rows (doc_id, rank, kind, a, z) of a pattern; the condition sees m, before, after, text, a, z."""
    p = _text(pattern)
    return f"""
    SELECT doc_id, {rank} AS rank, '{kind}' AS kind, a, z FROM (
      SELECT doc_id, text, ms[i] AS m, right(rs[i], 1) AS before, left(rs[i + 1], 1) AS after,
             list_sum(list_transform(rs[1:i], lambda x: length(x)))
               + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS a,
             a + length(ms[i]) AS z
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
              SELECT doc_id, text, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS rs
              FROM documents WHERE text IS NOT NULL) WHERE len(ms) > 0))
    WHERE {condition}"""


def _spans_query(parts: list[str], base: list[str]) -> str:
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)
    shown = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)
    own = ", ".join(_text(k) for k in base)
    one = "kind || ':' || a::BIGINT || ':' || z::BIGINT"
    return f"""
    WITH spans AS ({" UNION ALL ".join(parts)}),
    by_doc AS (
      SELECT doc_id, {counts},
             string_agg({one}, ',' ORDER BY a, rank) FILTER (kind IN ({own})) AS base,
             string_agg({one}, ',' ORDER BY a, rank) AS spans
      FROM spans GROUP BY doc_id)
    SELECT doc_id, {shown}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents LEFT JOIN by_doc USING (doc_id)"""


DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = f"""list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda k:
  CASE WHEN k % 2 = 1 THEN substr(reverse({DIGITS}), k, 1)::INT
       WHEN substr(reverse({DIGITS}), k, 1)::INT > 4 THEN substr(reverse({DIGITS}), k, 1)::INT * 2 - 9
       ELSE substr(reverse({DIGITS}), k, 1)::INT * 2 END)) % 10 = 0"""
CODE = "replace(m, ' ', '')"
MOD97 = f"""list_reduce(list_prepend(0, list_transform(
  string_split(substr({CODE}, 5) || left({CODE}, 4), ''), lambda c:
  CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
  lambda s, v: (s * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"""
NEAR = "lower(substr(text, greatest(a - 47, 1)::BIGINT, least(a, 48)::BIGINT) || ' ' || substr(text, (z + 1)::BIGINT, 48))"

PII = _spans_query(
    [
        _spans("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        _spans(
            "ip", 1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "len(list_filter(string_split(m, '.'), lambda x: x::HUGEINT > 255)) = 0",
        ),
        _spans("card", 2, r"[0-9]([\x20-]?[0-9])+", f"length({DIGITS}) BETWEEN 12 AND 19 AND {LUHN}"),
        _spans("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 9 AND 15"),
        _spans(
            "iban", 4, r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}",
            f"NOT regexp_matches(before || after, '[A-Za-z0-9]') AND length({CODE}) BETWEEN 15 AND 34 AND {MOD97}",
        ),
        _spans(
            "ssn", 5, r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
            "NOT regexp_matches(before || after, '[0-9-]') AND NOT regexp_matches(m, '^(000|666|9)|-00-|0000$') "
            f"AND regexp_matches({NEAR}, 'ssn|social security|tax id')",
        ),
    ],
    ["email", "ip", "card", "phone"],
)

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
SECRETS = _spans_query(
    [
        _spans(
            "assign", 0, _ASSIGN + "([A-Za-z0-9+/_.=-]+)",
            f"length(regexp_extract(m, {_text(_ASSIGN + '([A-Za-z0-9+/_.=-]+)')}, 1)) >= 6",
        ),
        _spans("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 20"),
        _spans("hex", 2, "[0-9a-f]+", "length(m) >= 24"),
        _spans("hosting", 3, "gh[pousr]_[A-Za-z0-9]+", "length(m) >= 40"),
        _spans("payment", 4, "[rs]k_live_[A-Za-z0-9]+", "length(m) >= 24"),
        _spans("chat", 5, "xox[abprs]-[A-Za-z0-9-]+", "length(m) >= 20"),
        _spans(
            "webtoken", 6, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
            "length(m) >= 40 AND NOT regexp_matches(before || after, '[A-Za-z0-9_-]')",
        ),
        _spans("private_key", 7, "-----BEGIN [A-Z ]*PRIVATE KEY-----", "length(m) >= 27"),
    ],
    ["assign", "access", "hex"],
)

_REACH = """
  reach AS (
    SELECT {id} AS id, {id} AS other FROM {rows}
    UNION
    SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
  found AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
{_REACH.format(id="doc_id", rows="documents")}
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept
FROM sets JOIN found ON id = doc_id"""

NEAR_VECTORS = f"""
WITH RECURSIVE units AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM units x JOIN units y ON x.vec_id <> y.vec_id
  WHERE list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v)) / sqrt(list_dot_product(y.v, y.v)) >= 0.95),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
{_REACH.format(id="vec_id", rows="embeddings")}
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings LEFT JOIN counts ON a = vec_id JOIN found ON id = vec_id"""

_HEX = "(instr('0123456789abcdef', substr(h, {at}, 1)) - 1)"
_TWENTY = [
    "(" + " + ".join(_HEX.format(at=5 * i + k + 1) + f" * {16 ** (4 - k)}" for k in range(5)) + ")" for i in range(8)
]
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({group} // {32 ** (3 - k)}) % 32 + 1, 1)"
    for group in _TWENTY
    for k in range(4)
)
WARC = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h FROM pages),
first AS (SELECT p, max(page_id) AS holder FROM payloads GROUP BY p)
SELECT page_id, strlen(p)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM payloads JOIN first USING (p)"""

# The pages of the test tables: one article, flat blocks, these four references.
PAGE_TEXT = r"""
WITH blocks AS (
  SELECT page_id, url, list_filter(list_transform(
    regexp_split_to_array(regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1),
      '<br>', ' ', 'g'), '</?b>', '', 'g'), '</?(?:p|h[1-6]|ul|li|div)(?:\s[^>]*)?>'),
    lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x, '&quot;', '"'), '&middot;', '·'),
      '&copy;', '©'), '&lt;', '<'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS b
  FROM pages)
SELECT page_id, url, coalesce(array_to_string(b, chr(10)), '') AS text,
       length(coalesce(array_to_string(b, chr(10)), ''))::BIGINT AS n_chars
FROM blocks"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
LEXICAL = f"""
WITH terms AS (SELECT doc_id, {_TERMS} AS t FROM documents),
facts AS (SELECT count(*) FILTER (len(t) > 0) AS docs, sum(len(t))::BIGINT AS total FROM terms),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
held AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM terms)
         WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM held, facts GROUP BY term, docs),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term), facts GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 20"""

# CRC-32 of the digits of an id, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
  lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
  lambda u, z: xor(u // 2, 3988292384 * (u % 2)))))"""
# Stretches of equal words at a distance, found through factors of four words.
RUNS = rf"""
WITH plain AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC} AS h FROM documents),
sized AS (SELECT *, len(w)::BIGINT AS n, h // 10 AS g FROM plain),
placed AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM sized),
words AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
    list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END)
    ELSE w END AS w FROM placed),
fours AS (SELECT doc_id, i, hash(w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS f
          FROM (SELECT doc_id, w, unnest(range(0, n - 3)) AS i FROM words)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM fours x JOIN fours y ON x.doc_id = y.doc_id AND x.f = y.f AND y.i > x.i),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS s, max(i) + 4 + q AS e FROM islands GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, s, e - s AS l, min(q) AS q FROM stretches WHERE e - s >= greatest(12, 2 * q) GROUP BY doc_id, s, e),
by_doc AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
         list({{'l': l, 's': s, 'q': q}} ORDER BY l DESC, s, q)[1] AS top
  FROM runs GROUP BY doc_id),
dropped AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(s + q, s + l)) AS i FROM runs) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS text
  FROM (SELECT doc_id, unnest(w) AS v, unnest(range(0, n)) AS i FROM words) ANTI JOIN
       (SELECT doc_id, unnest(gone) AS i FROM dropped) USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.q AS period,
       (1000 * top.l) // top.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM words LEFT JOIN by_doc USING (doc_id) LEFT JOIN kept USING (doc_id)"""

ORACLES: dict[str, str] = {
    "op4_near_duplicates": NEAR_DUPLICATES,
    "op5_html_text": PAGE_TEXT,
    "op6_pii": PII,
    "op8_near_vectors": NEAR_VECTORS,
    "op9_secrets": SECRETS,
    "op10_warc": WARC,
    "op11_lexical_search": LEXICAL,
    "op12_periodic_runs": RUNS,
}
