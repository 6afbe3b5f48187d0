"""DuckDB SQL for the registered queries.

Shared views are named common table expressions; a query gets those it names.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint

from siftwood import fixtures as fx
from siftwood.functions import text

NEWLINE = "\n"
html4 = {name: chr(code) for name, code in name2codepoint.items()}


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(items) -> str:
    return "[" + ", ".join(lit(w) for w in items) + "]"


def tok(col: str) -> str:
    return rf"list_filter(string_split_regex(lower({col}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def norm(tokens: str) -> str:
    # Letter by letter, so a whole list can be folded as one text.
    wide = f"translate(array_to_string({tokens}, ' '), {lit(text.FULL_WIDTH)}, {lit(text.HALF_WIDTH)})"
    folded = f"translate(lower({wide}), {lit(text.ACCENTED)}, {lit(text.UNACCENTED)})"
    return f"list_filter(string_split({folded}, ' '), lambda t: t <> '')"


def stop(tokens: str, lang: str | None) -> str:
    if lang is None:
        every = sorted({w for ws in text.STOPWORDS.values() for w in ws})
        return f"list_filter({tokens}, lambda t: NOT list_contains({words(every)}, t))"
    cases = " ".join(f"WHEN {lit(code)} THEN {words(ws)}" for code, ws in text.STOPWORDS.items())
    return f"list_filter({tokens}, lambda t: NOT list_contains(CASE {lang} {cases} ELSE []::VARCHAR[] END, t))"


CJK = r"\p{Han}\p{Hiragana}\p{Katakana}ー"


def bigrams(tokens: str) -> str:
    runs = f"flatten(list_transform({tokens}, lambda t: regexp_extract_all(t, '[{CJK}]+|[^{CJK}]+')))"
    return (
        f"flatten(list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '^[{CJK}]') AND length(r) > 1 "
        f"THEN list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) ELSE [r] END))"
    )


def analyzed(col: str, lang: str | None = None) -> str:
    return norm(stop(bigrams(tok(col)), lang))


def rules(col: str, items, flags: str = "") -> str:
    for pattern, replacement in items:
        col = f"regexp_replace({col}, {lit(flags + pattern)}, {lit(re.sub(r'[$]([0-9])', r'\\\1', replacement))}, 'g')"
    return col


def entities(col: str) -> str:
    pairs = ", ".join(f"{lit(k)}: {lit(' ' if k == 'nbsp' else v)}" for k, v in (html4 | {"apos": "'"}).items())
    code = "CASE WHEN lower(n[2]) = 'x' THEN TRY_CAST('0x' || n[3:] AS BIGINT) ELSE TRY_CAST(n[2:] AS BIGINT) END"
    real = f"({code}) BETWEEN 1 AND 55295 OR ({code}) BETWEEN 57344 AND 1114111"
    number = f"CASE WHEN ({code}) = 160 THEN ' ' WHEN {real} THEN chr(({code})::INT) END"
    one = f"coalesce(CASE WHEN n[1] = '#' THEN {number} ELSE (MAP {{{pairs}}})[n] END, '&' || n || ';')"
    entity = lit("&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
    decoded = f"list_transform(regexp_extract_all({col}, {entity}, 1), lambda n: {one})"
    return (
        f"array_to_string(list_transform(list_zip(string_split_regex({col}, {entity}), {decoded}), "
        f"lambda z: z[1] || coalesce(z[2], '')), '')"
    )


def html(col: str) -> str:
    return rf"trim(regexp_replace({entities(rules(col, text.HTML_RULES))}, '[ \t\n\r\f]+', ' ', 'g'))"


def markdown(col: str) -> str:
    inline = entities(rules("q", text.MARKDOWN_INLINE_RULES))
    prose = lambda x: (
        f"array_to_string(list_transform(string_split_regex({x}, '`+'), "
        f"lambda q, j: CASE WHEN j % 2 = 1 THEN {inline} ELSE q END), '')"
    )
    line = (
        rf"CASE WHEN regexp_matches(s, {lit(text.TABLE_LINE)}) "
        rf"THEN trim(regexp_replace(s, '[ \t]*\|[ \t]*', ' ', 'g')) ELSE s END"
    )
    lines = f"string_split({rules('p', text.MARKDOWN_BLOCK_RULES, '(?m)')}, {lit(NEWLINE)})"
    block = prose(f"array_to_string(list_transform({lines}, lambda s: {line}), {lit(NEWLINE)})")
    plain = (
        f"array_to_string(list_transform(string_split_regex({col}, {lit('(?m)' + text.FENCE)}), "
        f"lambda p, i: CASE WHEN i % 2 = 1 THEN {block} ELSE p END), '')"
    )
    return rf"trim(regexp_replace({plain}, '\n[ \t\n]*\n[ \t]*', {lit(NEWLINE)}, 'g'), {lit(' ' + chr(9) + NEWLINE)})"


def hash_code(term: str = "term") -> str:
    return f"CAST('0x' || substr(md5({term}), 1, 8) AS BIGINT)"


POST_COLUMNS = """CAST(NULL AS VARCHAR) AS name, split_part(d.text, '.', 1) AS full_name, e.event_type = 'error' AS wip,
  d.text AS body_md, CAST(NULL AS VARCHAR) AS body_html, e.ts AS created_at, e.ts AS updated_at,
  'https://posts.example/' || d.doc_id AS url, 'user_' || e.user_id AS created_by"""

# Changed since the last good run.
SINCE = """updated_at >= coalesce((SELECT CASE WHEN arg_max(exit_status, run_no) = 'success' THEN CAST(arg_max(executed_at, run_no) AS TIMESTAMP) END FROM run_log), TIMESTAMP '1970-01-01')"""

CTES = {
    # --- fixture views
    "posts": f"""SELECT CAST(d.doc_id AS VARCHAR) AS number, {POST_COLUMNS}
  FROM documents d JOIN events e ON d.doc_id = e.event_id""",
    "revisions": f"""SELECT CAST(d.doc_id AS VARCHAR) AS number, {POST_COLUMNS}, e.event_id AS arrival
  FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)""",
    "numbered": """SELECT *, row_number() OVER (ORDER BY updated_at, arrival) AS n FROM revisions""",
    "run_log": """SELECT strftime(ts, '%Y-%m-%d') AS executed_at, max(event_id) AS run_no,
    CASE WHEN count(*) FILTER (event_type = 'error') > 2 * count(*) FILTER (event_type = 'purchase')
      THEN 'error' ELSE 'success' END AS exit_status
  FROM events GROUP BY 1""",
    "requests": r"""SELECT item_id * 1000 + pos AS qid, trim(l[pos + 1]) AS query,
    CAST(5 + (item_id * 1000 + pos) % 20 AS INT) AS topk, CAST((item_id * 1000 + pos) % 4 AS INT) AS from_,
    CAST(3 + (item_id * 1000 + pos) % 7 AS INT) AS size, (item_id * 1000 + pos) % 2 = 0 AS hybrid,
    CASE (item_id * 1000 + pos) % 3 WHEN 1 THEN ['body'] WHEN 2 THEN ['title', 'url'] END AS search_fields,
    embedding AS vec
  FROM (SELECT item_id, l, unnest(range(len(l))) AS pos
        FROM (SELECT item_id, string_split_regex(text, '[.,\n]') AS l FROM benchmark))
  JOIN embeddings ON vec_id = item_id""",
    "markdown_docs": rf"""SELECT doc_id, source, n_chars, lang, '# About ' || source || ' #{NEWLINE}{NEWLINE}' ||
    regexp_replace(regexp_replace(regexp_replace(text, ', (\p{{L}}+)', ', **\1**', 'g'), ' (\p{{L}}+)\.', ' _\1_.', 'g'),
      '\n(\p{{L}}+)', {lit(NEWLINE + "`**" + chr(92) + "1`")}, 'g') ||
    '{NEWLINE}{NEWLINE}Language{NEWLINE}--------{NEWLINE}> quoted ' || lang ||
    '{NEWLINE}{NEWLINE}- first [**' || source || '**](https://docs.example/a_b){NEWLINE}2. ![logo](x.png) <b>bold</b> a &lt; b &amp;amp; c{NEWLINE}{NEWLINE}| name | size |{NEWLINE}|:-----|-----:|{NEWLINE}| ' ||
    source || ' | ' || n_chars || ' |{NEWLINE}{NEWLINE}***{NEWLINE}```sql{NEWLINE}# not a heading{NEWLINE}select **{NEWLINE}```{NEWLINE}end *' || lang || '*{NEWLINE}' AS md
  FROM documents""",
    "plain_docs": f"SELECT doc_id, {markdown('md')} AS plain FROM markdown_docs",
    "japanese_docs": f"SELECT doc_id, translate(lower(text), {lit(fx.LATIN)}, {lit(fx.JAPANESE)}) AS text, lang FROM documents",
    "wide_docs": "SELECT doc_id, translate(text, 'aeinstAEINST0123456789', "
    + lit("".join(chr(ord(c) + 0xFEE0) for c in "aeinstAEINST0123456789"))
    + ") AS text, lang FROM documents",
    # --- index tables of the posts
    "plain_terms": f"""SELECT number AS doc_id, 'title' AS field, unnest({tok('full_name')}) AS term FROM posts
  UNION ALL SELECT number, 'body', unnest({tok('body_md')}) FROM posts""",
    "all_terms": """SELECT doc_id, field, term FROM plain_terms
  UNION ALL SELECT number, 'docid', number FROM posts UNION ALL SELECT number, 'url', url FROM posts""",
    "post": "SELECT field, term, doc_id, count(*) AS tf FROM all_terms GROUP BY ALL",
    "lens": "SELECT field, doc_id, sum(tf) AS dl FROM post GROUP BY ALL",
    "freqs": "SELECT field, term, count(*) AS df FROM post GROUP BY ALL",
    "stats": "SELECT field, count(*) AS n, sum(dl) / count(*) AS avg_len FROM lens GROUP BY ALL",
    # --- what queries ask for, per field
    "asked_tokens": f"SELECT qid, f.field, {tok('query')} AS l FROM requests, (VALUES ('title'), ('body')) f(field)",
    "asked": """SELECT qid, field, l FROM asked_tokens WHERE len(l) > 0
  UNION ALL SELECT qid, f.field, [query] FROM requests, (VALUES ('docid'), ('url')) f(field) WHERE query <> ''""",
    "asked_keys": """SELECT d.doc_id AS qid, f.field,
    [CASE WHEN d.doc_id % 2 = 0 THEN CAST(d.doc_id AS VARCHAR) ELSE 'https://posts.example/' || d.doc_id END] AS l
  FROM documents d, (VALUES ('docid'), ('url')) f(field)""",
    "asked_terms": """SELECT qid, field, len(list_distinct(l)) AS n_terms, term, count(*) AS qtf
  FROM (SELECT qid, field, l, unnest(l) AS term FROM asked) GROUP BY ALL""",
    "scored": """SELECT q.qid, q.field, p.doc_id, count(*) AS found, max(q.n_terms) AS n_terms,
    sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 3 / (tf + 2 * (0.25 + 0.75 * dl / avg_len))) AS s
  FROM asked_terms q JOIN post p USING (field, term) JOIN freqs USING (field, term)
    JOIN lens l ON l.field = q.field AND l.doc_id = p.doc_id JOIN stats st ON st.field = q.field
  GROUP BY ALL""",
    "scored_and": "SELECT * FROM scored WHERE found = n_terms",
    "text_and": "SELECT qid, doc_id, round(sum(s), 6) AS score FROM scored_and WHERE field IN ('title', 'body') GROUP BY ALL",
    "body_or": "SELECT qid, doc_id, round(s, 6) AS score FROM scored WHERE field = 'body'",
    "fields_or": "SELECT qid, doc_id, round(sum(s), 6) AS score FROM scored GROUP BY ALL",
    # --- vectors
    "units": """SELECT CAST(vec_id AS VARCHAR) AS doc_id, list_transform(embedding, lambda x:
      CAST(CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS FLOAT)) AS vec
  FROM embeddings""",
    "asked_vecs": """SELECT r.qid, r.topk, r.from_, r.size, r.hybrid, r.search_fields, u.vec
  FROM requests r JOIN units u ON CAST(r.qid // 1000 AS VARCHAR) = u.doc_id""",
    "doc_vecs": "SELECT p.number AS doc_id, u.vec FROM posts p JOIN units u ON u.doc_id = p.number",
}


def near(a: str, b: str) -> str:
    return f"round((1 + list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))) / 2, 6)"


RANK = "CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank"

CTES |= {
    # --- combined scores: the k nearest matches add their neighbour score
    "near_matches": f"SELECT qid, doc_id, score, {near('v.vec', 'a.vec')} AS near FROM text_and JOIN doc_vecs v USING (doc_id) JOIN asked_vecs a USING (qid)",
    "hybrid_scores": """SELECT m.qid, m.doc_id, round(m.score + coalesce(n.near, 0), 6) AS score
  FROM text_and m LEFT JOIN (
    SELECT qid, doc_id, near FROM near_matches
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY near DESC, doc_id) <= 5) n USING (qid, doc_id)""",
    "batch_dense": f"""SELECT qid, doc_id, {near('v.vec', 'a.vec')} AS score FROM asked_vecs a, doc_vecs v WHERE NOT hybrid
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) <= any_value(topk) OVER (PARTITION BY qid)""",
    "batch_terms": """SELECT s.qid, s.doc_id, round(sum(s.s), 6) AS bm25
  FROM scored_and s JOIN requests r USING (qid)
  WHERE r.hybrid AND (r.search_fields IS NULL OR list_contains(r.search_fields, s.field)) GROUP BY ALL""",
    "batch_near": f"""SELECT qid, doc_id, {near('v.vec', 'a.vec')} AS near
  FROM batch_terms JOIN doc_vecs v USING (doc_id) JOIN asked_vecs a USING (qid)
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY near DESC, doc_id) <= any_value(topk) OVER (PARTITION BY qid)""",
    "batch_scores": """SELECT qid, doc_id, score FROM batch_dense
  UNION ALL SELECT qid, doc_id, round(bm25 + coalesce(near, 0), 6) FROM batch_terms LEFT JOIN batch_near USING (qid, doc_id)""",
    # --- hash encoder: signed counts per component, then unit length
    "clean_posts": f"SELECT p.number AS docid, p.full_name AS title, d.plain AS body, p.url FROM posts p JOIN plain_docs d ON CAST(d.doc_id AS VARCHAR) = p.number",
    "enc_terms": f"""SELECT 'd' AS side, docid AS key, unnest({tok("title || ' ' || body")}) AS term FROM clean_posts
  UNION ALL SELECT 'q', CAST(qid AS VARCHAR), unnest({tok('query')}) FROM requests""",
    "enc_sums": f"""SELECT side, key, CAST(code % 64 AS INT) AS dim, sum(CASE WHEN (code // 64) % 2 = 0 THEN 1 ELSE -1 END) AS x
  FROM (SELECT side, key, {hash_code()} AS code FROM enc_terms) GROUP BY ALL HAVING x <> 0""",
    "enc_norms": "SELECT side, key, sqrt(sum(x * x)) AS norm FROM enc_sums GROUP BY ALL",
    "enc_units": "SELECT side, key, dim, CAST(CAST(CAST(x / norm AS FLOAT) AS DOUBLE) AS DOUBLE) AS x FROM enc_sums JOIN enc_norms USING (side, key)",
    "enc_pairs": "SELECT q.key AS qid, d.key AS doc_id, sum(q.x * d.x) AS s FROM enc_units q JOIN enc_units d USING (dim) WHERE q.side = 'q' AND d.side = 'd' GROUP BY ALL",
    "enc_scores": """SELECT CAST(q.key AS BIGINT) AS qid, d.key AS doc_id, round((1 + coalesce(s, 0)) / 2, 6) AS score
  FROM (SELECT key FROM enc_norms WHERE side = 'q') q, (SELECT key FROM enc_norms WHERE side = 'd') d
  LEFT JOIN enc_pairs p ON p.qid = q.key AND p.doc_id = d.key
  QUALIFY row_number() OVER (PARTITION BY q.key ORDER BY score DESC, d.key) <= 20""",
    "built_terms": f"""SELECT docid AS doc_id, 'title' AS field, unnest({analyzed('title')}) AS term FROM clean_posts
  UNION ALL SELECT docid, 'body', unnest({analyzed('body')}) FROM clean_posts
  UNION ALL SELECT docid, 'docid', docid FROM clean_posts UNION ALL SELECT docid, 'url', url FROM clean_posts""",
    "built_postings": "SELECT DISTINCT field, term, doc_id FROM built_terms",
}


def _with(sql: str) -> str:
    """Prefix the shared views a statement names, in order of definition."""
    needed, todo = set(), [sql]
    while todo:
        body = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,) {name}\b", body):
                needed.add(name)
                todo.append(CTES[name])
    views = ",\n".join(f"{name} AS ({CTES[name]})" for name in CTES if name in needed)
    return f"WITH {views}\n{sql}" if views else sql


def term_list(source: str, tokens: str) -> str:
    return f"SELECT doc_id, len(l) AS n, array_to_string(l, ' ') AS terms FROM (SELECT doc_id, {tokens} AS l FROM {source})"


STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') AS {0}"
FLAT = (
    "number, name, full_name, wip, body_md, body_html, "
    + STAMP.format("created_at") + ", " + STAMP.format("updated_at") + ", url, created_by"
)


def components(source: str, key: str, vec: str = "vec") -> str:
    return (
        f"SELECT {key}, CAST(pos AS INT) AS pos, round(CAST({vec}[pos + 1] AS DOUBLE), 6) AS value "
        f"FROM (SELECT {key}, {vec}, unnest(range(len({vec}))) AS pos FROM {source})"
    )


def paged(scores: str, start: str, stop: str) -> str:
    """A page of ranked hits with totals; requests without hits keep one row."""
    return f"""SELECT r.qid, h.rank, h.doc_id, h.score, coalesce(t.total, 0) AS total FROM requests r
  LEFT JOIN (SELECT qid, count(*) AS total FROM {scores} GROUP BY 1) t USING (qid)
  LEFT JOIN (SELECT x.*, {RANK} FROM {scores} x) h ON h.qid = r.qid AND h.rank > {start} AND h.rank <= {stop}"""


def oracle_sql() -> dict[str, str]:
    ranked = lambda scores, k: f"SELECT qid, rank, doc_id, score FROM (SELECT *, {RANK} FROM {scores}) WHERE rank <= {k}"
    sql = {
        "read_jsonl": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "conform_docs": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, CASE WHEN lang <> 'fr' THEN source ELSE '' END AS title FROM documents",
        "read_table": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "read_feed_pages": f"""SELECT CAST((n - 1) // 100 + 1 AS INT) AS page, CAST((n - 1) % 100 AS INT) AS pos, number, full_name, wip,
  body_md AS body, {STAMP.format('updated_at')}, url, created_by AS author FROM numbered""",
        "incremental_scan": f"""SELECT number, arrival, strftime(updated_at, '%Y-%m-%d') AS day FROM revisions WHERE {SINCE}""",
        "page_rows": "SELECT number, arrival, n, (n - 1) // 100 + 1 AS page FROM numbered",
        "chunk_rows": "SELECT doc_id, n_chars, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 64 AS chunk FROM documents",
        "write_jsonl": f"SELECT {FLAT} FROM posts",
        "upsert_posts": f"""SELECT {FLAT} FROM (
  SELECT * EXCLUDE (arrival) FROM revisions WHERE length(body_md) >= 1500 QUALIFY row_number() OVER (PARTITION BY number ORDER BY arrival DESC) = 1
  UNION ALL BY NAME SELECT * FROM posts WHERE number NOT IN (SELECT number FROM revisions WHERE length(body_md) >= 1500))""",
        "collect_run": f"""SELECT {FLAT} FROM (
  SELECT * EXCLUDE (arrival) FROM revisions WHERE {SINCE}
  QUALIFY row_number() OVER (PARTITION BY number ORDER BY updated_at DESC, arrival DESC) = 1
  UNION ALL BY NAME SELECT * FROM posts WHERE number NOT IN (SELECT number FROM revisions WHERE {SINCE}))""",
        "posts_schema": f"SELECT {FLAT} FROM posts",
        "publish_index": f"SELECT number AS docid, full_name AS title, body_md AS body, url, {STAMP.format('updated_at')} FROM posts",
        "crawl_state": "SELECT CAST(1 AS BIGINT) AS run_no, '2024-02-01' AS executed_at, strftime(max(updated_at), '%Y-%m-%d') AS last_updated_at, 'success' AS exit_status FROM revisions",
        "validate_records": """SELECT url, CASE WHEN label = 5 THEN NULL ELSE number END AS docid,
  concat_ws(', ', CASE WHEN label = 5 THEN 'missing key' END, CASE WHEN label = 3 THEN 'vector width' END,
    CASE WHEN label = 7 THEN 'zero vector' END) AS reasons
FROM posts LEFT JOIN embeddings ON CAST(vec_id AS VARCHAR) = number""",
        "map_columns": "SELECT n_chars, doc_id AS docid, lang AS source, text AS body FROM documents",
        "flatten_author": "SELECT number, full_name, url, created_by FROM posts",
        "index_fields": f"SELECT number AS docid, full_name AS title, body_md AS body, url, {STAMP.format('created_at')}, {STAMP.format('updated_at')}, CAST(NULL AS INT) AS vec, 7 AS fields FROM posts",
        "doc_text": "SELECT number, full_name || ' ' || body_md AS text FROM posts",
        "select_source": f"SELECT qid, rank, doc_id, score, full_name AS title, url FROM ({ranked('text_and', 10)}) JOIN posts ON number = doc_id",
        "search_requests": r"""SELECT qid, url_decode(replace(regexp_extract(url, '[?&]query=([^&]*)', 1), '+', ' ')) AS query,
  coalesce(TRY_CAST(regexp_extract(url, '[?&]topk=([^&]*)', 1) AS INT), 200) AS topk,
  coalesce(TRY_CAST(regexp_extract(url, '[?&]from=([^&]*)', 1) AS INT), 0) AS from_,
  coalesce(TRY_CAST(regexp_extract(url, '[?&]size=([^&]*)', 1) AS INT), 10) AS size,
  coalesce(TRY_CAST(regexp_extract(url, '[?&]hybrid=([^&]*)', 1) AS INT), 1) <> 0 AS hybrid,
  nullif(regexp_extract(url, '[?&]search_fields=([^&]*)', 1), '') AS search_fields
FROM (SELECT qid, '/search?query=' || url_encode(query) || '&hybrid=' || CAST(hybrid AS INT)
    || CASE WHEN qid % 5 <> 0 THEN '&topk=' || topk || '&from=' || from_ || '&size=' || size ELSE '' END
    || coalesce('&search_fields=' || array_to_string(search_fields, ','), '') AS url FROM requests)""",
        "strip_markdown": f"SELECT doc_id, plain AS text, md AS text_raw FROM plain_docs JOIN markdown_docs USING (doc_id)",
        "html_text": f"SELECT page_id, {html('html')} AS text FROM pages",
        "preprocess_chain": f"SELECT page_id, {markdown('h')} AS text FROM (SELECT page_id, {html('html')} AS h FROM pages)",
        "tokenize": term_list("documents", tok("text")),
        "stop_filter": term_list("documents", stop(tok("text"), "lang")),
        "normalize_terms": term_list("wide_docs", norm(tok("text"))),
        "cjk_bigrams": term_list("japanese_docs", bigrams(tok("text"))),
        "analyze": term_list(
            "(SELECT * FROM japanese_docs UNION ALL SELECT -1 - doc_id, text, lang FROM wide_docs)", analyzed("text", "lang")
        ),
        "postings": "SELECT field, term, doc_id, count(*) AS tf FROM plain_terms GROUP BY ALL",
        "doc_lengths": "SELECT field, doc_id, CAST(dl AS BIGINT) AS len FROM lens",
        "doc_freqs": "SELECT field, term, df FROM freqs",
        "field_stats": "SELECT field, n, round(avg_len, 6) AS avg_len FROM stats",
        "keyword_terms": "SELECT 'docid' AS field, number AS term, number AS doc_id FROM posts UNION ALL SELECT 'url', url, number FROM posts",
        "build_index": """SELECT 'docs' AS index_table, count(*) AS rows FROM clean_posts
UNION ALL SELECT 'postings', count(*) FROM built_postings
UNION ALL SELECT 'dfs', count(*) FROM (SELECT DISTINCT field, term FROM built_postings)
UNION ALL SELECT 'lengths', count(*) FROM (SELECT DISTINCT field, doc_id FROM built_postings)
UNION ALL SELECT 'stats', count(*) FROM (SELECT DISTINCT field FROM built_postings)
UNION ALL SELECT 'vectors', count(*) FROM enc_norms WHERE side = 'd'""",
        "unit_vector": components(
            "(SELECT vec_id, list_transform(v, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])))) AS vec "
            "FROM (SELECT vec_id, list_transform(embedding, lambda x: x * CAST(label AS FLOAT)) AS v FROM embeddings WHERE label <> 0))",
            "vec_id",
        ),
        "mean_pool": """SELECT vec_id // 8 AS doc_id, CAST(pos AS INT) AS pos, round(avg(CAST(embedding[pos + 1] AS DOUBLE)), 6) AS value
FROM (SELECT vec_id, label, embedding, unnest(range(64)) AS pos FROM embeddings) WHERE NOT (label = 0 AND vec_id % 8 > 0) GROUP BY 1, 2""",
        "cls_pool": components(
            "(SELECT vec_id // 8 AS doc_id, arg_min(embedding, vec_id % 8) AS vec FROM embeddings GROUP BY 1)", "doc_id"
        ),
        "encode_text": f"""WITH t AS (SELECT doc_id, unnest({tok('text')}) AS term FROM documents),
c AS (SELECT doc_id, {hash_code()} AS code FROM t),
s AS (SELECT doc_id, code % 64 AS dim, sum(CASE WHEN (code // 64) % 2 = 0 THEN 1 ELSE -1 END) AS x FROM c GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM s GROUP BY ALL HAVING norm > 0)
SELECT n.doc_id, CAST(pos AS INT) AS pos, round(CAST(CAST(coalesce(x, 0) / norm AS FLOAT) AS DOUBLE), 6) AS value
FROM (SELECT doc_id, norm, unnest(range(64)) AS pos FROM n) n LEFT JOIN s ON s.doc_id = n.doc_id AND s.dim = n.pos""",
        "encode_tokens": f"""WITH t AS (SELECT doc_id, unnest({tok('text')}) AS term FROM documents)
SELECT doc_id, CAST(pos AS INT) AS pos, round(CAST(CAST(sum(CASE WHEN length(term) % 8 = pos THEN 1 ELSE 0 END) / count(*) AS FLOAT) AS DOUBLE), 6) AS value
FROM t, (SELECT unnest(range(8)) AS pos) GROUP BY ALL""",
        "attach_vectors": """SELECT number AS docid, full_name AS title, CAST(len(embedding) AS INT) AS width,
  round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM posts LEFT JOIN embeddings ON CAST(vec_id AS VARCHAR) = number""",
        "knn_exact": f"""SELECT qid, rank, doc_id, score FROM (SELECT *, {RANK} FROM (
  SELECT CAST(q.doc_id AS BIGINT) AS qid, d.doc_id, {near('d.vec', 'q.vec')} AS score FROM units q, units d)) WHERE rank <= 10""",
        "knn_all_cells": f"""SELECT qid, rank, doc_id, score FROM (SELECT qid, doc_id, score, {RANK} FROM (
  SELECT CAST(q.doc_id AS BIGINT) AS qid, d.doc_id, {near('d.vec', 'q.vec')} AS score,
    round((1 + list_dot_product(list_transform(d.vec, lambda x: CAST(round(x * CAST(127 AS FLOAT)) AS DOUBLE) / 127),
      list_transform(q.vec, lambda x: round(CAST(x AS DOUBLE) * 127) / 127))) / 2, 6) AS coarse
  FROM units q, units d QUALIFY row_number() OVER (PARTITION BY q.doc_id ORDER BY coarse DESC, d.doc_id) <= 20)) WHERE rank <= 10""",
        "knn_filtered": f"SELECT qid, rank, doc_id, score FROM (SELECT *, {RANK} FROM (SELECT qid, doc_id, near AS score FROM near_matches)) WHERE rank <= 10",
        "match_all": "SELECT qid, field, doc_id FROM scored_and WHERE field IN ('title', 'body')",
        "match_any": "SELECT qid, field, doc_id FROM scored WHERE field IN ('title', 'body')",
        "match_keyword": "SELECT qid, field, number AS doc_id FROM asked_keys JOIN posts ON l[1] = CASE field WHEN 'docid' THEN number ELSE url END",
        "bm25_field": "SELECT qid, doc_id, score FROM body_or",
        "most_fields": "SELECT qid, doc_id, score FROM fields_or",
        "bm25_search": paged("fields_and", "2", "10"),
        "top_k": ranked("body_or", 10),
        "bm25_block_max": f"SELECT qid, rank, doc_id, score FROM ({ranked('fields_or', 10)})",
        "page_hits": f"SELECT * FROM ({ranked('body_or', 7)}) WHERE rank > 3",
        "total_hits": "SELECT qid, count(doc_id) AS total FROM (SELECT qid FROM requests) LEFT JOIN fields_or USING (qid) GROUP BY 1",
        "page_progress": f"""SELECT (n - 1) // 100 + 1 AS page, count(*) AS posts, max(n) AS read,
  round(max(n) / (SELECT count(*) FROM revisions), 6) AS share
FROM (SELECT row_number() OVER (ORDER BY updated_at, arrival) AS n FROM revisions WHERE {SINCE}) GROUP BY 1""",
        "dense_search": f"""SELECT a.qid, h.rank, h.doc_id, h.score, t.total
FROM (SELECT CAST(key AS BIGINT) AS qid FROM enc_norms WHERE side = 'q') a
JOIN (SELECT qid, count(*) AS total FROM enc_scores GROUP BY 1) t USING (qid)
LEFT JOIN (SELECT x.*, {RANK} FROM enc_scores x) h ON h.qid = a.qid AND h.rank > 3 AND h.rank <= 12""",
        "hybrid_search": paged("hybrid_scores", "0", "12"),
        "batch_search": paged("batch_scores", "r.from_", "r.from_ + r.size"),
        "assemble_results": f"""SELECT r.qid, r.query, p.total, coalesce(string_agg(rank || ':' || doc_id, ' ' ORDER BY rank), '') AS hits
FROM requests r JOIN ({paged("batch_scores", "r.from_", "r.from_ + r.size")}) p USING (qid) GROUP BY ALL""",
        "check_requests": """SELECT qid, reason FROM (SELECT qid, CASE
  WHEN topk <> 7 AND size = 5 AND NOT hybrid THEN 'neither vector nor fields'
  WHEN topk = 7 THEN 'vector width'
  WHEN hybrid AND topk = 9 THEN 'unknown field'
  WHEN topk = 11 THEN 'bad page' END AS reason FROM requests) WHERE reason IS NOT NULL""",
        "stream_upsert": f"SELECT {FLAT} FROM (SELECT * FROM numbered QUALIFY row_number() OVER (PARTITION BY number ORDER BY n DESC) = 1)",
        "stream_dedupe_once": f"SELECT number, {STAMP.format('updated_at')} FROM revisions",
        "stream_dedupe": f"SELECT number, {STAMP.format('updated_at')} FROM revisions",
    }
    sql["merge_buckets"], sql["collect_into"] = sql["upsert_posts"], sql["collect_run"]
    sql["search_segments"] = sql["bm25_search"]
    return {name: _with(body) for name, body in sql.items()}


CTES["fields_and"] = "SELECT qid, doc_id, round(sum(s), 6) AS score FROM scored_and GROUP BY ALL"
