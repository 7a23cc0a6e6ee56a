"""DuckDB SQL for the engine's queries, from common table expressions."""

from ..functions import lexicon as L


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


SPACE = L.SPACE_RE2
STOP = f"[{quoted(L.STOPWORDS)}]"
VERB = f"[{quoted(L.VERBS)}]"
TOKEN = L.token_pattern(L.LETTER_RE2).replace("'", "''")
ELISION = L.elision_pattern(L.LETTER_RE2).replace("'", "''")
CJK = f"[{L.CJK}]"


def norm(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'))"


def tokens(c: str) -> str:
    return f"flatten(list_transform(list_transform(regexp_extract_all({c}, '{TOKEN}'), lambda t: lower(t)), lambda t: CASE WHEN regexp_matches(t, '{ELISION}') THEN [regexp_extract(t, '{ELISION}', 1), regexp_extract(t, '{ELISION}', 2)] ELSE [t] END))"


def content(c: str) -> str:
    return f"list_filter({tokens(c)}, lambda t: NOT list_contains({STOP}, t) AND (len(t) >= 3 OR regexp_matches(t, '{CJK}')))"


def sents(c: str) -> str:
    marked = rf"regexp_replace(regexp_replace(regexp_replace({c}, '([.!?]){SPACE}+', '\1' || chr(1), 'g'), '([。！？]){SPACE}*', '\1' || chr(1), 'g'), '\n{{2,}}', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {norm('s')}), lambda s: s <> '')"


def grams(c: str, low: int, high: int) -> str:
    return "list_concat(" + ", ".join(f"list_transform(range(1, greatest(len({c}) - {k - 2}, 1)), lambda i: array_to_string({c}[i:i + {k - 1}], ' '))" for k in range(low, high + 1)) + ")"


DOCS = f"""
    norm AS (SELECT {norm('text')} AS text, coalesce(source, 'inline') AS source, doc_id AS doc_ord FROM documents),
    docs AS (SELECT doc_id, arg_min(text, doc_ord) AS text, arg_min(source, doc_ord) AS source, min(doc_ord) AS doc_ord FROM
             (SELECT 'doc-' || substr(sha1(source || ':' || text), 1, 12) AS doc_id, * FROM norm WHERE text <> '') GROUP BY doc_id)"""
CHUNKS = f"""{DOCS},
    words AS (SELECT *, string_split(text, ' ') AS w FROM docs),
    chunks AS (SELECT 'chunk-' || substr(sha1(doc_id || ':' || idx || ':' || text), 1, 12) AS chunk_id, * FROM
               (SELECT doc_id, source, doc_ord, idx::INT AS idx, array_to_string(w[idx * 140 + 1:idx * 140 + 180], ' ') AS text FROM
                (SELECT *, unnest(range(0, greatest(0, ceil((len(w) - 180) / 140))::BIGINT + 1)) AS idx FROM words)))"""
INDEX = f"""{CHUNKS},
    toks AS (SELECT chunk_id, {content('text')} AS t FROM chunks),
    lengths AS (SELECT chunk_id, len(t)::INT AS len FROM toks),
    postings AS (SELECT chunk_id, term, count(*)::INT AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM toks) GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df, ln(1 + ((SELECT count(*) FROM lengths) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings GROUP BY term)"""
STATS = "(SELECT count(*) AS n, CASE WHEN avg(len) > 0 THEN avg(len) ELSE 1.0 END AS avg_len FROM lengths)"
QUESTION = "which of the then are not onouin that the ntti thereea and enanst"


def bm25(asked: str, k: int = 5) -> str:
    return f"""{INDEX}, asked AS ({asked}),
    terms AS (SELECT DISTINCT qid, unnest({content('question')}) AS term FROM asked),
    scored AS (SELECT qid, chunk_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(len, 1) / avg_len))) AS score
               FROM terms JOIN postings USING (term) JOIN dfs USING (term) JOIN lengths USING (chunk_id), {STATS} GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id)::INT AS rank FROM scored WHERE score > 0 QUALIFY rank <= {k})"""


BATCH = bm25("SELECT item_id AS qid, text AS question FROM benchmark")
COSINE = """WITH v AS (SELECT lpad(vec_id::VARCHAR, 12, '0') AS chunk_id, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT q.vec_id AS qid, v.chunk_id, coalesce(list_cosine_similarity(q.e, v.e), 0) AS score FROM v q, v WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id)::INT AS rank FROM s QUALIFY rank <= 5)
    SELECT qid, chunk_id, round(score, 6) AS score, rank FROM r WHERE score > 0"""
PHRASES = f"""{CHUNKS},
    lines AS (SELECT chunk_id, unnest(generate_series(1, len(x))) AS s, unnest(x) AS line FROM (SELECT chunk_id, {sents('text')} AS x FROM chunks)),
    toked AS (SELECT chunk_id, s, unnest(generate_series(1, len(x))) AS i, unnest(x) AS t FROM (SELECT chunk_id, s, {tokens('line')} AS x FROM lines)),
    good AS (SELECT *, i - row_number() OVER (PARTITION BY chunk_id, s ORDER BY i) AS run FROM toked WHERE NOT list_contains({STOP}, t) AND len(t) >= 3 AND NOT regexp_matches(t, '^\\p{{Nd}}+$')),
    runs AS (SELECT chunk_id, s, run, list(t ORDER BY i) AS w FROM good GROUP BY ALL),
    phrases AS (SELECT chunk_id, phrase, count(*) AS n FROM (SELECT chunk_id, unnest({grams('w', 1, 3)}) AS phrase FROM runs)
                WHERE NOT list_has_any(string_split(phrase, ' '), {VERB}) GROUP BY ALL)"""
CONNECTOR = f"[{quoted(sorted(L.CONNECTORS))}]"
JOINT = f"[{quoted(L.JOINTS)}]"
KIND = "MAP {" + ", ".join(f"'{v}': '{k}'" for v, k in L.VERBS.items()) + "}"
ENTITIES = f"""{PHRASES},
    blotted AS (SELECT chunk_id, s, line, string_split(array_to_string(list_transform(regexp_extract_all(line, '{L.WORD_OR_GAP.replace("'", "''")}'), lambda p:
        CASE WHEN regexp_matches(p, '{L.CAPITAL}') OR list_contains({CONNECTOR}, lower(p)) THEN p WHEN list_contains({JOINT}, p) THEN ' ' ELSE chr(1) END), ''), chr(1)) AS x FROM lines),
    spans AS (SELECT chunk_id, s, line, unnest(generate_series(1, len(x))) AS i, trim(unnest(x)) AS x FROM blotted),
    names AS (SELECT chunk_id, s, i, regexp_replace(regexp_replace(x, '{L.LAST_CONNECTORS}', ''), '{L.FIRST_CONNECTORS}', '') AS name, line FROM spans),
    proper AS (SELECT chunk_id, lower(name) AS key, arg_min(name, (s, i)) AS name, count(*) AS np FROM names
               WHERE NOT (i = 1 AND regexp_matches(line, '{L.CAPITAL}') AND NOT contains(name, ' ')) AND len(name) >= 3 AND NOT list_contains({STOP}, lower(name)) GROUP BY 1, 2),
    candidates AS (SELECT chunk_id, key, coalesce(max(name), key) AS name, CASE WHEN max(np) > 0 THEN 'proper_noun' ELSE 'concept' END AS type, sum(np + n)::INT AS mentions, sum(2.0 * np + n * (0.5 + 0.5 * len(string_split(key, ' ')))) AS score
                   FROM (SELECT chunk_id, key, name, np, 0 AS n FROM proper UNION ALL SELECT chunk_id, phrase, NULL, 0, n FROM phrases) GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, len(string_split(key, ' ')) DESC, key) AS r FROM candidates),
    inner_ones AS (SELECT DISTINCT a.chunk_id, a.key FROM ranked a JOIN ranked b ON a.chunk_id = b.chunk_id AND b.r < a.r AND contains(' ' || b.key || ' ', ' ' || a.key || ' ')),
    ents AS (SELECT chunk_id, (row_number() OVER (PARTITION BY chunk_id ORDER BY r) - 1)::INT AS ent_ord, key AS entity_key, name, type, mentions FROM ranked ANTI JOIN inner_ones USING (chunk_id, key) QUALIFY ent_ord < 12)"""
RELATIONS = f"""{ENTITIES},
    placed AS (SELECT chunk_id, s, line, lower(line) AS low, entity_key AS k, strpos(lower(line), entity_key) AS pos FROM lines JOIN ents USING (chunk_id) WHERE contains(lower(line), entity_key)),
    linked AS (SELECT a.chunk_id, a.s, a.pos AS pos, a.k AS source, b.pos AS pos_b, b.k AS target, a.line[1:200] AS context,
               CASE WHEN b.pos > a.pos + len(a.k) THEN substr(a.low, a.pos + len(a.k), b.pos - a.pos - len(a.k)) ELSE '' END AS between FROM placed a JOIN placed b ON a.chunk_id = b.chunk_id AND a.s = b.s AND (a.pos, a.k) < (b.pos, b.k)),
    typed AS (SELECT *, coalesce({KIND}[list_filter({tokens('between')}, lambda t: list_contains({VERB}, t))[1]], '{L.UNTYPED}') AS type FROM linked),
    firsts_of AS (SELECT * FROM typed QUALIFY row_number() OVER (PARTITION BY chunk_id, source, target, type ORDER BY s, pos, source, pos_b, target) = 1),
    rels AS (SELECT chunk_id, (row_number() OVER (PARTITION BY chunk_id ORDER BY s, pos, source, pos_b, target) - 1)::INT AS rel_ord, source, target, type, context, CASE WHEN type = '{L.UNTYPED}' THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM firsts_of)"""
FACTS = f"""{RELATIONS},
    mentions AS (SELECT chunk_id, doc_ord, idx, ent_ord, entity_key, name, type, mentions FROM ents JOIN chunks USING (chunk_id)),
    links AS (SELECT chunk_id, doc_ord, idx, rel_ord, source, target, type, context, weight FROM rels JOIN (SELECT chunk_id, doc_ord, idx FROM chunks) USING (chunk_id)),
    nodes AS (SELECT entity_key, arg_min(name, (doc_ord, idx, ent_ord)) AS name, CASE WHEN bool_or(type = 'proper_noun') THEN 'proper_noun' ELSE arg_min(type, (doc_ord, idx, ent_ord)) END AS type,
              sum(mentions)::BIGINT AS mentions, string_agg(DISTINCT chunk_id, ',' ORDER BY chunk_id) AS chunks FROM mentions GROUP BY 1)"""
TRADE = """
    tedges AS (SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target, count(*)::DOUBLE AS weight FROM lineitem GROUP BY ALL),
    tnodes AS (SELECT 'p' || p_partkey AS k FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier),
    both_ways AS (SELECT source AS a, target AS b, weight FROM tedges UNION ALL SELECT target, source, weight FROM tedges)"""
SWEEPS = f"""{TRADE},
    share AS (SELECT a, b, weight / sum(weight) OVER (PARTITION BY a) AS share FROM both_ways),
    sweep AS (SELECT 0 AS i, 'p1' AS key, 1.0::DOUBLE AS score
              UNION ALL SELECT i, key, sum(score) FROM (
                SELECT s.i + 1 AS i, b AS key, 0.85 * score * share AS score FROM sweep s JOIN share ON key = a WHERE s.i < 20
                UNION ALL SELECT DISTINCT s.i + 1, 'p1', (1 - 0.85)::DOUBLE FROM sweep s WHERE s.i < 20) GROUP BY ALL),
    ranks AS (SELECT key, score FROM sweep WHERE i = 20 AND score > 0)"""
def scores(k1: float, b: float, name: str) -> str:
    """CTEs up to {name}_best: the pool of 20 of each question by BM25 so weighed."""
    return f"""{name}_s AS (SELECT qid, chunk_id, sum(idf * tf * {k1 + 1} / (tf + {k1} * ({1 - b} + {b} * greatest(len, 1) / avg_len))) AS score
               FROM terms JOIN postings USING (term) JOIN dfs USING (term) JOIN lengths USING (chunk_id), {STATS} GROUP BY ALL),
    {name}_best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id)::INT AS rank FROM {name}_s WHERE score > 0 QUALIFY rank <= 20)"""


RANKINGS = f"""{BATCH}, {scores(1.5, 0.75, 'keyword')}, {scores(1.2, 0.0, 'vector')},
    parts AS (SELECT qid, chunk_id, 'keyword' AS signal, 0.7 / (60 + rank) AS part FROM keyword_best UNION ALL SELECT qid, chunk_id, 'vector', 1.0 / (60 + rank) FROM vector_best)"""
HITS = f"""{BATCH}, hits AS (SELECT qid, rank, chunk_id, text, source FROM best JOIN chunks USING (chunk_id))"""

ORACLE_SQL = {
    "normalize_text": f"SELECT doc_id, {norm('text')} AS norm FROM documents",
    "document_ids": f"WITH {DOCS} SELECT doc_id, doc_ord, len(text) AS n FROM docs",
    "chunk_windows": f"WITH {CHUNKS} SELECT doc_id, idx, len(string_split(text, ' ')) AS n_words, text FROM chunks",
    "chunk_ids": f"WITH {CHUNKS} SELECT chunk_id, doc_id, idx FROM chunks",
    "tokenize_docs": f"SELECT doc_id, array_to_string({tokens('text')}, ' ') AS tokens FROM documents",
    "tokenize_turns": f"SELECT conv_id, turn, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT conv_id, turn, {tokens('text')} AS t FROM conversations)",
    "content_tokens": f"SELECT doc_id, array_to_string({content('text')}, ' ') AS tokens FROM documents",
    "sentences": f"SELECT doc_id, (unnest(generate_series(1, len(x))) - 1)::INT AS at, unnest(x) AS sentence FROM (SELECT doc_id, {sents('text')} AS x FROM documents)",
    "ngram_counts": f"SELECT gram, count(*) AS n FROM (SELECT unnest({grams('t', 1, 2)}) AS gram FROM (SELECT {content('text')} AS t FROM documents)) GROUP BY 1",
    "term_freq": f"WITH {INDEX} SELECT * FROM postings",
    "doc_freq_idf": f"WITH {INDEX} SELECT term, df, round(idf, 9) AS idf FROM dfs",
    "length_stats": f"WITH {INDEX} SELECT n, round(avg_len, 9) AS avg_len FROM {STATS}",
    "bm25_topk": f"WITH {bm25(f'''SELECT 0::BIGINT AS qid, '{QUESTION}' AS question''')} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM best",
    "bm25_batch": f"WITH {BATCH} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM best",
    "cosine_batch": COSINE,
    "cosine_topk": f"SELECT * FROM ({COSINE}) WHERE rank <= 2 AND score > 0.2 AND chunk_id <> lpad(qid::VARCHAR, 12, '0')",
    "hashing_embed": f"WITH {INDEX} SELECT chunk_id, 512 AS dim, CASE WHEN len(t) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM toks",
    "native_embed": f"""WITH {INDEX}, g AS (SELECT chunk_id, gram, count(*) AS n FROM (SELECT chunk_id, unnest({grams('t', 1, 2)}) AS gram FROM toks) GROUP BY ALL),
        h AS (SELECT chunk_id, (('0x' || md5(gram)[1:15])::BIGINT % 512)::INT AS pos, CASE WHEN md5(gram)[16] < '8' THEN 1.0::DOUBLE ELSE -1.0 END * (1 + ln(n)) AS v FROM g),
        p AS (SELECT chunk_id, pos, sum(v) AS v FROM h GROUP BY ALL HAVING abs(sum(v)) > 1e-12)
        SELECT chunk_id, pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY chunk_id)), 6) AS value FROM p""",
    "key_phrases": f"WITH {PHRASES} SELECT * FROM phrases",
    "node_merge": f"WITH {FACTS} SELECT * FROM nodes",
    "edge_merge": f"""WITH {FACTS}, firsts AS (SELECT source, target, type, sum(weight) AS weight, min((doc_ord, idx, rel_ord)) AS first, arg_min(context, (doc_ord, idx, rel_ord)) AS context FROM links WHERE source <> target AND source IN (SELECT entity_key FROM nodes) AND target IN (SELECT entity_key FROM nodes) GROUP BY ALL)
        SELECT source, target, sum(weight)::DOUBLE AS weight, string_agg(type, ',' ORDER BY first) AS types, arg_min(context, first) AS context FROM firsts GROUP BY ALL""",
    "degree_top": f"WITH {TRADE} SELECT a AS entity, count(*) AS degree FROM both_ways GROUP BY 1 ORDER BY degree DESC, entity LIMIT 5",
    "graph_stats": f"""WITH RECURSIVE {TRADE}, reach AS (SELECT k, k AS r FROM tnodes WHERE k = (SELECT min(a) FROM both_ways) UNION SELECT b, r FROM reach JOIN both_ways ON k = a)
        SELECT (SELECT count(*) FROM tnodes) AS entities, (SELECT count(*) FROM tedges) AS relationships, (SELECT count(*) FROM tnodes WHERE k NOT IN (SELECT a FROM both_ways)) + 1 AS components""",
    "components": """WITH e AS (SELECT 'o' || o_orderkey AS o, 'c' || o_custkey AS c FROM orders), n AS (SELECT o AS k FROM e UNION ALL SELECT 'c' || c_custkey FROM customer)
        SELECT k AS entity_key, least(k, coalesce(CASE WHEN k[1] = 'c' THEN k END, e.c)) AS component FROM n LEFT JOIN e ON k = e.o""",
    "khop": f"""WITH RECURSIVE {TRADE}, seed AS (SELECT * FROM (VALUES (0::BIGINT, 'p1'), (1, 's3'), (1, 'p7'), (2, 'nobody')) s(qid, key) WHERE key IN (SELECT k FROM tnodes)),
        reach AS (SELECT qid, key, 0 AS hops FROM seed UNION SELECT qid, b, hops + 1 FROM reach JOIN both_ways ON key = a WHERE hops < 2) SELECT qid, key, min(hops) AS hops FROM reach GROUP BY ALL""",
    "ppr_fixed20": f"WITH RECURSIVE {SWEEPS} SELECT key, round(score, 9) AS score FROM ranks",
    "ppr_converged": f"""WITH RECURSIVE {TRADE}, share AS (SELECT a, b, weight / sum(weight) OVER (PARTITION BY a) AS share FROM both_ways),
        seed AS (SELECT * FROM (VALUES (0::BIGINT, 'p1'), (1, 's3'), (1, 'p7'), (1, 'nobody')) s(qid, key) WHERE key IN (SELECT k FROM tnodes)),
        restart AS (SELECT qid, key, 1.0::DOUBLE / count(*) OVER (PARTITION BY qid) AS r FROM seed),
        reach AS (SELECT qid, key, 0 AS hops FROM seed UNION SELECT qid, b, hops + 1 FROM reach JOIN both_ways ON key = a WHERE hops < 2), near AS (SELECT DISTINCT qid, key FROM reach),
        sweep AS (SELECT 0 AS i, qid, key, r AS score FROM restart
                  UNION ALL SELECT i, qid, key, sum(score) FROM (
                    SELECT s.i + 1 AS i, s.qid, b AS key, 0.85 * score * share AS score FROM sweep s JOIN share ON key = a WHERE s.i < 100
                    UNION ALL SELECT DISTINCT s.i + 1, r.qid, r.key, (1 - 0.85)::DOUBLE * r.r FROM sweep s JOIN restart r USING (qid) WHERE s.i < 100) GROUP BY ALL),
        moved AS (SELECT x.i, x.qid, sum(abs(x.score - coalesce(y.score, 0))) AS delta FROM sweep x LEFT JOIN sweep y ON y.i = x.i - 1 AND y.qid = x.qid AND y.key = x.key WHERE x.i > 0 GROUP BY ALL),
        stop AS (SELECT qid, coalesce(min(i) FILTER (delta < 1e-8), 100) AS i FROM moved GROUP BY qid)
        SELECT qid, key, round(score, 7) AS score FROM sweep JOIN stop USING (qid, i) JOIN near USING (qid, key) WHERE score > 0""",
    "chunk_graph_score": f"WITH RECURSIVE {SWEEPS} SELECT target AS chunk_id, round(sum(score), 9) AS score FROM ranks JOIN tedges ON source = key GROUP BY 1",
    "coverage_seeds": f"""WITH {FACTS}, asked AS (SELECT DISTINCT item_id AS qid, unnest({content('text')}) AS w FROM benchmark),
        parts AS (SELECT DISTINCT entity_key, mentions, unnest(string_split(entity_key, ' ')) AS w FROM nodes), sizes AS (SELECT entity_key, count(*) AS size FROM parts GROUP BY 1),
        hit AS (SELECT qid, entity_key, mentions, size FROM parts JOIN asked USING (w) JOIN sizes USING (entity_key) GROUP BY ALL HAVING count(*) = size)
        SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY size DESC, mentions DESC, entity_key) - 1)::INT AS pos, entity_key AS key FROM hit QUALIFY pos < 12""",
    "rrf_fuse": f"WITH {RANKINGS} SELECT qid, chunk_id, round(sum(part), 9) AS score, string_agg(signal, ',' ORDER BY signal) AS signals FROM parts GROUP BY ALL",
    "context_budget": f"""WITH {HITS}, blocks AS (SELECT qid, rank, '[' || rank || '] (source: ' || source || ')' || chr(10) || text AS block FROM hits),
        fit AS (SELECT *, sum(len(block)) OVER (PARTITION BY qid ORDER BY rank) AS used FROM blocks QUALIFY used <= 2000 OR rank = 1)
        SELECT qid, string_agg(substr(block, 1, 2000), chr(10) || chr(10) ORDER BY rank) AS context FROM fit GROUP BY 1""",
    "extractive_answer": f"""WITH {HITS}, q AS (SELECT qid, list_distinct({content('question')}) AS q FROM asked),
        ls AS (SELECT qid, rank, generate_subscripts(x, 1) AS pos, unnest(x) AS line FROM (SELECT qid, rank, {sents('text')} AS x FROM hits)),
        lt AS (SELECT *, list_distinct({content('line')}) AS t FROM ls),
        sc AS (SELECT *, len(list_intersect(q, t)) AS common FROM lt JOIN q USING (qid)),
        s AS (SELECT *, common / greatest(1, len(q)) + 0.5 * (common / len(t)) - 0.05 * greatest(0, rank - 1) AS score FROM sc WHERE common > 0),
        once AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid, lower(line) ORDER BY score DESC, rank, pos) = 1),
        best3 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank, pos) AS n FROM once QUALIFY n <= 3),
        said AS (SELECT qid, string_agg(line || ' [' || rank || ']', ' ' ORDER BY n) AS a FROM best3 GROUP BY 1)
        SELECT qid, CASE WHEN qid NOT IN (SELECT qid FROM hits) THEN 'I don''t have enough information in the indexed corpus to answer that.'
            ELSE coalesce(a, 'The retrieved passages do not directly answer that question. Closest available context is listed in the sources below.') END AS answer FROM asked LEFT JOIN said USING (qid)""",
    "incremental_dedup": f"""WITH rows_in AS (SELECT doc_id::BIGINT AS ord, text, source FROM documents UNION ALL SELECT item_id::BIGINT, text, 'benchmark' FROM benchmark),
        ids AS (SELECT 'doc-' || substr(sha1(coalesce(source, 'inline') || ':' || {norm('text')}), 1, 12) AS doc_id, ord, source FROM rows_in WHERE {norm('text')} <> '')
        SELECT doc_id, min(ord) AS doc_ord FROM ids GROUP BY 1 HAVING NOT bool_or(coalesce(source, '') = 'benchmark')""",
    "upsert_last_wins": "SELECT doc_id, n_chars::BIGINT AS value FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, toxic::BIGINT FROM labels",
    "entities": f"WITH {ENTITIES} SELECT * FROM ents",
    "relations": f"WITH {RELATIONS} SELECT * FROM rels",
    "communities": """WITH e AS (SELECT 'o' || o_orderkey AS o, 'c' || o_custkey AS c FROM orders), m AS (SELECT c, o AS k FROM e UNION ALL SELECT c, c FROM (SELECT 'c' || c_custkey AS c FROM customer) UNION SELECT c, c FROM e)
        SELECT min(k) AS community, count(*)::INT AS size, string_agg(k, ',' ORDER BY k) AS members FROM (SELECT DISTINCT * FROM m) GROUP BY c""",
    "edge_integrity": f"WITH {TRADE} SELECT source, target, weight FROM tedges",
    "html_corpus": rf"SELECT page_id, {norm(r'''regexp_replace(regexp_replace(html, '(?s)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g')''')} AS text FROM pages",
}
