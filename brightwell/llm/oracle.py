"""DuckDB SQL for the queries that SQL can express."""

_GROUPS = "SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1"

OP6 = f"""
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM documents JOIN ({_GROUPS}) g ON coalesce(text, '') = t
"""

# five hex digits make four base32 digits
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) % 32, 1)), '')"

OP2 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
     f AS (SELECT h AS fh, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, strlen(t) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f ON h = fh
"""

OP7 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_KINDS = [
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
]


def _found(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
    SELECT doc_id, {number} AS k, '{kind}' AS kind, a.start, a.start + length(hits[i]) AS stop FROM (
        SELECT doc_id, hits, vals, unnest(range(1, len(hits) + 1)) AS i, parts FROM (
            SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {group}) AS vals, regexp_split_to_array(t, '{pattern}') AS parts FROM d)),
        LATERAL (SELECT list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start) a
    WHERE length(vals[i]) >= {least}"""


OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({' UNION ALL '.join(_found(n, *k) for n, k in enumerate(_KINDS))}),
     g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                  string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, k) AS spans FROM m GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""

OP10 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
     s AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 49], ' ')) AS h, md5(array_to_string(w[i:i + 49], ' ')) AS m
           FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
     f AS (SELECT h, m, min(doc_id) AS least FROM s GROUP BY 1, 2),
     r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM s JOIN f USING (h, m) WHERE s.doc_id > f.least),
     g AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM r GROUP BY 1),
     k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d)
           ANTI JOIN r USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = f"""
WITH t AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_TERMS} AS w FROM documents) WHERE len(w) > 0),
     s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM t),
     q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
     p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM t) SEMI JOIN q USING (term) GROUP BY ALL),
     f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY term, n_docs),
     i AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS part FROM p JOIN f USING (term), s),
     c AS (SELECT item_id, doc_id, sum(qtf * part)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING sum(qtf * part) > 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM c)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def _crc32(text: str) -> str:
    """Byte by byte, with table(t), the list of the 256 bytes' own remainders."""
    data = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::BIGINT, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {data}), lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])))"


_STEP = "xor(c >> 1, 3988292384 * (c % 2))"
_REMAINDER = "b"
for _ in range(8):
    _REMAINDER = _STEP.replace("c", _REMAINDER)

OP12 = f"""
WITH RECURSIVE e AS (SELECT list_transform(range(256), lambda b: {_REMAINDER}) AS t),
     u AS (SELECT doc_id, translate(w, {_LOWER}) AS w FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS w FROM documents)),
     g AS (SELECT doc_id, w, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || w AS k FROM u WHERE length(w) >= 6 GROUP BY ALL),
     h AS (SELECT w, n, {_crc32('k')} AS h FROM g, e),
     v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
     w AS (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
     o AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
     d AS (SELECT DISTINCT w.word AS a, o.word AS b FROM w JOIN o ON w.word = o.less),
     m AS (SELECT a, b FROM d UNION ALL SELECT b, a FROM d
           UNION ALL SELECT x.word, y.word FROM o x JOIN o y ON x.less = y.less AND x.i = y.i AND x.word <> y.word),
     z AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-w.n, b)) AS best, max(w.n) AS best_n FROM m JOIN w ON m.b = w.word GROUP BY 1),
     f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM w LEFT JOIN z USING (word)),
     s AS (SELECT word, word AS root, form AS further FROM f UNION ALL SELECT s.word, s.further, f.form FROM s JOIN f ON s.further = f.word)
SELECT f.word, n, n_near, form, form_n, root FROM f JOIN s ON f.word = s.word AND s.further IS NULL
"""

SQL = {"op11_search": OP11, "op12_variants": OP12, "op2_warc": OP2, "op6_exact_dedup": OP6, "op7_nearest": OP7, "op8_secrets": OP8, "op10_substrings": OP10}
