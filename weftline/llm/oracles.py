"""DuckDB SQL for queries of this subpackage, put together from common table expressions."""

from __future__ import annotations

LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(column: str) -> str:
    return LOWER.format(column)


def jaccard(docs: str, shingle: int, percent: int, p: str = "j") -> str:
    """CTEs up to {p}_out(doc_id, n_shingles, component_id). Needs WITH RECURSIVE."""
    return f"""
    {p}_w AS (SELECT doc_id, regexp_extract_all({low('text')}, '{WORD}') AS w FROM {docs}),
    {p}_s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {shingle} THEN list_transform(range(1, len(w) - {shingle - 2}), lambda i: array_to_string(w[i:i + {shingle - 1}], ' '))
                   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS s FROM {p}_w),
    {p}_n AS (SELECT doc_id, count(*) AS n FROM {p}_s GROUP BY 1),
    {p}_both AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM {p}_s x JOIN {p}_s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    {p}_link AS (SELECT a, b FROM {p}_both JOIN {p}_n x ON x.doc_id = a JOIN {p}_n y ON y.doc_id = b WHERE 100 * i >= {percent} * (x.n + y.n - i)),
    {p}_reach AS (SELECT a, b FROM {p}_link UNION SELECT r.a, l.b FROM {p}_reach r JOIN {p}_link l ON r.b = l.a),
    {p}_least AS (SELECT a, min(b) AS m FROM {p}_reach GROUP BY 1),
    {p}_out AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
                FROM {docs} d LEFT JOIN {p}_n USING (doc_id) LEFT JOIN {p}_least ON a = d.doc_id)"""


def decontamination(docs: str, window: int = 10, p: str = "c") -> str:
    """CTEs up to {p}_out(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    return f"""
    {p}_dw AS (SELECT doc_id, regexp_extract_all({low('text')}, '{ALNUM}') AS w FROM {docs}),
    {p}_iw AS (SELECT item_id, regexp_extract_all({low('text')}, '{ALNUM}') AS w FROM benchmark),
    {p}_win AS (SELECT item_id, least(len(w), {window}) AS k, unnest(list_transform(range(1, len(w) - least(len(w), {window}) + 2), lambda i: array_to_string(w[i:i + least(len(w), {window}) - 1], ' '))) AS g FROM {p}_iw WHERE len(w) > 0),
    {p}_k AS (SELECT DISTINCT k FROM {p}_win),
    {p}_dg AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM {p}_dw, {p}_k WHERE len(w) >= k),
    {p}_hit AS (SELECT doc_id, item_id, i, d.k FROM {p}_dg d JOIN {p}_win b ON d.g = b.g AND d.k = b.k),
    {p}_word AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM {p}_hit) GROUP BY 1),
    {p}_item AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM {p}_hit) GROUP BY 1),
    {p}_out AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
                FROM {p}_dw d LEFT JOIN {p}_word USING (doc_id) LEFT JOIN {p}_item USING (doc_id))"""


def mixing(docs: str, seed: int = 17, p: str = "m") -> str:
    """CTEs up to {p}_out(doc_id, size, source, source_size, target, copies)."""
    return f"""
    {p}_d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS key FROM {docs}),
    {p}_t AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS r FROM {p}_d GROUP BY source),
    {p}_w AS (SELECT *, [5, 2, 1][((r - 1) % 3 + 1)::INT] AS w, sum(s) OVER () AS total FROM {p}_t),
    -- Sources in order of the level at which they reach their cap; clamped are those that reach it at the level of the rest.
    {p}_l AS (SELECT *, coalesce(sum(3 * s) OVER before, 0) AS capped, sum(w) OVER (ORDER BY s / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM {p}_w WINDOW before AS (ORDER BY s / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    {p}_c AS (SELECT *, w * (total - capped) > 3 * s * free AS clamp FROM {p}_l),
    {p}_f AS (SELECT *, coalesce(sum(3 * s) FILTER (WHERE clamp) OVER (), 0) AS all_capped, sum(w) FILTER (WHERE NOT clamp) OVER () AS all_free FROM {p}_c),
    {p}_g AS (SELECT source, s AS source_size, CASE WHEN clamp THEN (3 * s)::DOUBLE ELSE (w * (total - all_capped))::DOUBLE / all_free END AS target, CASE WHEN s = 0 THEN 0 WHEN clamp THEN 3 ELSE (w * (total - all_capped)) // (all_free * s) END AS whole FROM {p}_f),
    {p}_o AS (SELECT d.*, g.source_size, g.target, g.whole, sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS before FROM {p}_d d JOIN {p}_g g ON d.source IS NOT DISTINCT FROM g.source),
    {p}_out AS (SELECT doc_id, size, source, source_size, target, (whole + CASE WHEN before + size / 2 < target - whole * source_size THEN 1 ELSE 0 END)::BIGINT AS copies FROM {p}_o)"""


def quality(docs: str, p: str = "q") -> str:
    """CTEs up to {p}_out(doc_id, figures, base_failed, kept)."""
    count = lambda chars: f"len(regexp_replace(coalesce(text, ''), '[^{chars}]', '', 'g'))"
    return f"""
    {p}_w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, {count('#*$%&|<>')} AS n_symbols, {count('A-Z')} AS n_upper, {count('!')} AS n_exclaim,
              list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM {docs}),
    {p}_g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM {p}_w WHERE len(w) >= 5),
    {p}_r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM {p}_g) WHERE c > 1) GROUP BY 1),
    {p}_f AS (SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, n_upper, n_exclaim, len(l) AS n_lines
              FROM {p}_w LEFT JOIN {p}_r USING (doc_id)),
    {p}_out AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
                NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 6 * word_chars OR 100 * n_upper > 40 * word_chars OR 100 * n_exclaim > 6 * word_chars
                     OR 100 * n_dup_lines > 40 * n_lines OR word_chars < 2 * n_words OR word_chars > 30 * n_words) AS kept FROM {p}_f)"""


def sharding(docs: str, order: str, p: str = "s") -> str:
    """CTEs up to {p}_out: the columns of ``docs``, and size, shard (of 24) and r, the place in the order."""
    return f"""
    {p}_r AS (SELECT *, octet_length(encode(coalesce(text, ''))) + 8 AS size, row_number() OVER (ORDER BY {order}) AS r FROM {docs}),
    {p}_b AS (SELECT *, sum(size) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM {p}_r),
    {p}_out AS (SELECT *, least(23, before * 24 // total)::INT AS shard FROM {p}_b)"""


# Fixed value: the polynomial of CRC-32, its lowest bit first.
POLYNOMIAL = 0xEDB88320
#: CTEs up to crcs(doc_id, text_crc32): CRC-32 of the text's UTF-8 bytes, by a table of what each byte does.
CRC32 = f"""
    steps AS (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, {POLYNOMIAL}) ELSE a >> 1 END) AS c FROM range(256) t(i)),
    crc_table AS (SELECT list(c ORDER BY i) AS c FROM steps),
    hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    bytes_of AS (SELECT doc_id, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT) AS b FROM hexed),
    crcs AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, crc_table.c[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes_of, crc_table)"""

OP1 = f"WITH RECURSIVE {jaccard('documents', 4, 85)} SELECT doc_id, n_shingles, component_id FROM j_out"
OP4 = f"""WITH {sharding('documents', 'doc_id')}, {CRC32}
    SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY r) - 1)::BIGINT AS slot, NULL::INT AS grown_shard FROM s_out JOIN crcs USING (doc_id)"""
OP5 = f"WITH {mixing('documents')} SELECT doc_id, size, source_size, target, size * copies AS taken FROM m_out"
OP6 = f"WITH {decontamination('documents')} SELECT * FROM c_out"
OP7 = f"WITH {quality('documents')} SELECT * FROM q_out"

# Of fill-in-the-middle: unit k of the list that begins with 0 ends where a cut after k units lies.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
OP11 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
    h AS (SELECT *, list_transform(range(4), lambda i: ('0x' || x[8 * i + 1:8 * i + 8])::BIGINT) AS h, list_transform(regexp_extract_all(t, '{UNIT}'), lambda u: len(u)) AS s FROM d),
    f AS (SELECT *, len(s)::BIGINT AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
    c AS (SELECT *, coalesce(list_sum(s[1:least(h[1] % (n + 1), h[2] % (n + 1))]), 0)::BIGINT AS a, coalesce(list_sum(s[1:greatest(h[1] % (n + 1), h[2] % (n + 1))]), 0)::BIGINT AS b FROM f),
    o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || t[1:a] || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a) ELSE '<S>' || substr(t, b + 1) || '<P>' || t[1:a] || '<M>' || substr(t, a + 1, b - a) END AS o FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(o) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""
OP13 = f"""WITH w AS (SELECT doc_id, regexp_extract_all({low('text')}, '{ALNUM}') AS w FROM documents),
    d AS (SELECT doc_id, len(w)::BIGINT AS n, count(*) OVER () AS n_docs, (sum(len(w)) OVER ())::BIGINT AS length FROM w WHERE len(w) > 0),
    p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY ALL),
    t AS (SELECT term, floor(1000 * ln((2 * (SELECT count(*) FROM d) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p GROUP BY 1),
    i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({low('text')}, '{ALNUM}')) AS term FROM benchmark),
    s AS (SELECT item_id, doc_id, sum(t.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // length))))::BIGINT AS score FROM i JOIN t USING (term) JOIN p USING (term) JOIN d USING (doc_id) GROUP BY ALL)
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50"""

PIPELINE = f"""WITH RECURSIVE {quality('documents')},
    d1 AS (SELECT d.* FROM documents d JOIN q_out USING (doc_id) WHERE kept), {jaccard('d1', 5, 80)},
    d2 AS (SELECT d.* FROM d1 d JOIN j_out USING (doc_id) WHERE n_shingles = 0 OR component_id = doc_id), {decontamination('d2')},
    d3 AS (SELECT d.* FROM d2 d JOIN c_out USING (doc_id) WHERE NOT contaminated), {mixing('d3')},
    d4 AS (SELECT doc_id, d.text, d.lang, d.source, d.n_chars, unnest(range(copies)) AS copy FROM d3 d JOIN m_out m USING (doc_id)),
    {sharding('d4', 'doc_id, copy')}
    SELECT doc_id, text, lang, source, n_chars, size::BIGINT AS size, shard, (row_number() OVER (PARTITION BY shard ORDER BY r) - 1)::BIGINT AS slot FROM s_out"""
