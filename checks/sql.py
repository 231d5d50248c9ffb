"""The results of `queries.py` in DuckDB SQL over the same tables.

Chunks of the derived code files are listed from the template's definitions, not found.
"""

from checks import inputs as I
from lakesearch.operators.filters import EXCLUDED_DIRECTORIES
from lakesearch.operators.metrics import WORKLOAD_QUERIES
from lakesearch.operators.segments import CONTAINERS, MARKUP, PIECES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def filled(template: str) -> str:
    numbered = f"replace({quoted(template)}, '{{n}}', p_partkey::VARCHAR)"
    return f"replace({numbered}, '{{name}}', p_name)"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def best(repo: str, k: int) -> str:
    """Ranked neighbours of every embedding within its repository."""
    return f"""
      SELECT query_id, repo_id, chunk_pos, rank, score AS retrieval_score FROM (
        SELECT q.vec_id AS query_id, v.{repo} AS repo_id, v.vec_id AS chunk_pos, score,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) AS rank
        FROM (SELECT *, 0 AS one FROM embeddings) q
        JOIN (SELECT *, 0 AS one FROM embeddings) v ON q.{repo} = v.{repo},
        LATERAL (SELECT {dot('v.embedding', 'q.embedding')} AS score)
      ) WHERE rank <= {k}"""


def unnested(select: str, value: str) -> str:
    """(chunk_pos, i, x) of a list expression over the embeddings."""
    return f"""
      SELECT chunk_pos, i - 1 AS i, round(v[i]::DOUBLE, 6) AS x
      FROM (SELECT vec_id AS chunk_pos, {value} AS v FROM {select}), range(1, 65) r(i)"""


def hashed(rows: str, key: str, text: str) -> str:
    """(key, embedding) by hashed term counts, as a 64-entry FLOAT list."""
    return f"""
      SELECT {key}, list(x ORDER BY bucket) AS embedding FROM (
        SELECT g.{key}, g.bucket,
               CASE WHEN n.norm > 0 THEN coalesce(c.c, 0) / n.norm ELSE 0 END::FLOAT AS x
        FROM (SELECT {key}, b AS bucket FROM {rows}, range(64) r(b)) g
        LEFT JOIN (
          SELECT {key}, bucket, count(*) AS c FROM (
            SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS bucket FROM (
              SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9_]+', 0)) AS t
              FROM {rows}))
          GROUP BY ALL) c USING ({key}, bucket)
        LEFT JOIN (
          SELECT {key}, sqrt(sum(c * c)) AS norm FROM (
            SELECT {key}, bucket, count(*)::DOUBLE AS c FROM (
              SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS bucket FROM (
                SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9_]+', 0)) AS t
                FROM {rows}))
            GROUP BY ALL) GROUP BY {key}) n USING ({key}))
      GROUP BY {key}"""


DOCS = """
  SELECT 0 AS repo_id, doc_id AS chunk_pos, source || '/' || doc_id AS file_path,
         source AS name, text AS source_text, source || chr(10) || text AS body
  FROM documents"""

BENCH = """
  SELECT item_id AS query_id, 0 AS repo_id, text, (item_id % 15 + 1)::INT AS k FROM benchmark"""


def search(docs: str, queries: str) -> str:
    """CTEs up to `ranked`: shortlist of greatest(k, 10), pair scores and final ranks."""
    return f"""
    WITH d AS ({docs}), q AS ({queries}),
    dv AS (SELECT d.repo_id, d.chunk_pos, e.embedding FROM d
           JOIN (SELECT row_number() OVER () AS r, * FROM
                 ({hashed("(SELECT repo_id || '|' || chunk_pos AS did, body FROM d)", "did", "body")})) e
           ON e.did = d.repo_id || '|' || d.chunk_pos),
    qv AS ({hashed("q", "query_id", "text")}),
    hits AS (
      SELECT * FROM (
        SELECT q.query_id, q.repo_id, dv.chunk_pos, q.k,
               {dot('dv.embedding', 'qv.embedding')} AS retrieval_score,
               row_number() OVER (PARTITION BY q.query_id
                 ORDER BY {dot('dv.embedding', 'qv.embedding')} DESC, dv.chunk_pos) AS rank
        FROM q JOIN qv USING (query_id) JOIN dv ON dv.repo_id = q.repo_id)
      WHERE rank <= greatest(k, 10)),
    dt AS (SELECT repo_id, chunk_pos, regexp_extract_all(lower(body), '[a-z0-9_]+', 0) AS w FROM d),
    qt AS (SELECT query_id, repo_id, regexp_extract_all(lower(text), '[a-z0-9_]+', 0) AS w FROM q),
    df AS (SELECT repo_id, t, count(DISTINCT chunk_pos) AS df FROM
             (SELECT repo_id, chunk_pos, unnest(w) AS t FROM dt) GROUP BY ALL),
    n AS (SELECT repo_id, count(*) AS n FROM d GROUP BY 1),
    weights AS (
      SELECT query_id, t, ln(1 + (n.n - coalesce(df.df, 0) + 0.5) / (coalesce(df.df, 0) + 0.5)) AS weight
      FROM (SELECT DISTINCT query_id, repo_id, unnest(w) AS t FROM qt) x
      JOIN n USING (repo_id) LEFT JOIN df USING (repo_id, t)),
    total AS (SELECT query_id, sum(weight) AS total FROM weights GROUP BY 1),
    cand AS (SELECT hits.*, dt.w FROM hits JOIN dt USING (repo_id, chunk_pos)),
    found AS (
      SELECT c.query_id, c.chunk_pos, sum(weight) AS hit FROM
        (SELECT DISTINCT query_id, chunk_pos, unnest(w) AS t FROM cand) c
        JOIN weights USING (query_id, t) GROUP BY ALL),
    qb AS (SELECT DISTINCT query_id, w[i] || ' ' || w[i + 1] AS b
           FROM qt, LATERAL (SELECT unnest(range(1, len(w))) AS i)),
    cb AS (SELECT DISTINCT query_id, chunk_pos, w[i] || ' ' || w[i + 1] AS b
           FROM cand, LATERAL (SELECT unnest(range(1, len(w))) AS i)),
    nb AS (SELECT query_id, count(*) AS n FROM qb GROUP BY 1),
    pairs AS (SELECT query_id, chunk_pos, count(*) AS hit FROM cb JOIN qb USING (query_id, b) GROUP BY ALL),
    scored AS (
      SELECT hits.*, round(coalesce(found.hit / total.total, 0)
                           + coalesce(pairs.hit / nb.n, 0), 9) AS score
      FROM hits LEFT JOIN total USING (query_id) LEFT JOIN found USING (query_id, chunk_pos)
      LEFT JOIN nb USING (query_id) LEFT JOIN pairs USING (query_id, chunk_pos)),
    ranked AS (
      SELECT s.query_id, s.k, s.retrieval_score, s.score, d.file_path, d.name, d.source_text, s.chunk_pos,
             row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.rank) AS final_rank
      FROM scored s JOIN d USING (repo_id, chunk_pos))"""


def suffix() -> str:
    return f"{listed(I.TEMPLATES)}[(p_partkey % {len(I.TEMPLATES)} + 1)::INT]"


CODE_PATH = f"'src/' || lower(p_brand) || '/m_' || p_partkey || {suffix()}"
REPO = "substr(p_brand, 7)::BIGINT"


def masked(ext: str) -> str:
    """A template with what it hides replaced, listed piece by piece."""
    text = filled(I.TEMPLATES[ext])
    for kind, piece in I.MASKED[ext]:
        found = filled(piece)
        hidden = {
            "comment": f"regexp_replace({found}, '[^\\n]', ' ', 'g')",
            "string": f"'^' || regexp_replace(substr({found}, 2), '[^\\n]', '~', 'g')",
            "type": f"regexp_replace({found}, '[(){{}}=]', '~', 'g')",
        }[kind]
        text = f"replace({text}, {found}, {hidden})"
    return text

ODD_PATH = (
    f"{listed(I.DIRECTORIES)}[(p_partkey % {len(I.DIRECTORIES)} + 1)::INT] || '/' || "
    f"replace(p_name, ' ', '-') || "
    f"{listed(I.EXTENSIONS)}[((p_partkey + p_partkey // 7) % {len(I.EXTENSIONS)} + 1)::INT]"
)


def definition_rows(extensions: list[str]) -> str:
    """The definitions of the templates, one SELECT each, with their source text."""
    rows = []
    for ext, kind, name, first, last, doc in I.DEFINITIONS:
        if ext not in extensions:
            continue
        lines = I.TEMPLATES[ext].split("\n")[first - 1 : last]
        text = "\n".join(lines).lstrip()
        text = text.removeprefix(I.BEFORE.get((ext, name), ""))
        text = text.removesuffix(I.AFTER.get((ext, name), ""))
        rows.append(
            f"""SELECT {REPO} AS repo_id, {CODE_PATH} AS file_path, '{kind}' AS node_type,
              {filled(name)} AS name, {first} AS start_line, {last} AS end_line,
              {filled(text)} AS source_text,
              {filled(doc) if doc else 'NULL::VARCHAR'} AS docstring
            FROM part WHERE {suffix()} = '{ext}'"""
        )
    return " UNION ALL ".join(rows)


def whole_file_rows() -> str:
    rows = []
    for ext in (".md", ".rs"):
        template = I.TEMPLATES[ext]
        rows.append(
            f"""SELECT {REPO} AS repo_id, {CODE_PATH} AS file_path, 'file' AS node_type,
              'm_' || p_partkey || '{ext}' AS name, 1 AS start_line,
              {template.count(chr(10)) + 1} AS end_line, {filled(template)} AS source_text,
              NULL::VARCHAR AS docstring
            FROM part WHERE {suffix()} = '{ext}'"""
        )
    return " UNION ALL ".join(rows)


ALL_CHUNKS = f"{definition_rows(list(I.TEMPLATES))} UNION ALL {whole_file_rows()}"


def excluded(path: str) -> str:
    """True when a directory of the path is excluded."""
    name = "x"
    test = (
        f"{name} IN ({', '.join(quoted(d) for d in EXCLUDED_DIRECTORIES)}) "
        f"OR starts_with({name}, '.') OR ends_with({name}, '.egg-info')"
    )
    parts = f"string_split({path}, '/')"
    return f"len([x for x in ({parts})[1:len({parts}) - 1] if {test}]) > 0"


def extension(path: str) -> str:
    base = f"string_split({path}, '/')[-1]"
    return f"regexp_extract(substr({base}, 2), '\\.[^.]+$', 0)"


SOURCE_EXT = "('.py', '.go', '.js', '.ts', '.java', '.rs', '.c', '.cpp', '.h')"
REMOTE = ["https://", "http://", "git://", "git@", "ssh://", "file://"]


def remote(value: str) -> str:
    return "(" + " OR ".join(f"starts_with({value}, '{p}')" for p in REMOTE) + ")"


LANG_REPO = "CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END"
LANG_DOCS = f"""
  SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY string_split(file_path, '/')) - 1
           AS chunk_pos, file_path, name, source_text, name || chr(10) || source_text AS body
  FROM (SELECT {LANG_REPO} AS repo_id, source || '/' || doc_id || '.txt' AS file_path,
               doc_id || '.txt' AS name, text AS source_text FROM documents)"""

WORKLOAD = " UNION ALL ".join(
    f"SELECT {i} AS query_id, 0 AS repo_id, {quoted(WORKLOAD_QUERIES[i % 20])} AS text, 10 AS k"
    for i in range(30)
)


def floor_rank(p: float) -> str:
    return f"max(CASE WHEN rn = least(floor(n * {p}::DOUBLE), n - 1) THEN v END)"


def summary(group: str, rows: str, picks: dict[str, float]) -> str:
    chosen = ", ".join(f"{floor_rank(p)} AS {name}" for name, p in picks.items())
    return f"""
      SELECT {group} count(*) AS samples, avg(v) AS mean, min(v) AS "min", max(v) AS "max", {chosen}
      FROM ({rows}) {'GROUP BY ALL' if group else ''}"""


EVENT_ROWS = """
  SELECT event_type, value AS v, count(*) OVER (PARTITION BY event_type) AS n,
         row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rn
  FROM events WHERE value IS NOT NULL"""
LINE_ROWS = """
  SELECT l_extendedprice AS v, count(*) OVER () AS n,
         row_number() OVER (ORDER BY l_extendedprice) - 1 AS rn FROM lineitem"""
PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}

ORACLE: dict[str, str] = {
    "q_topk_single": f"""
      WITH c AS (SELECT list(m ORDER BY i) AS centre FROM (
        SELECT i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY i))
      SELECT vec_id AS chunk_pos, round({dot('embedding', 'centre')}, 6) AS retrieval_score
      FROM embeddings, c ORDER BY {dot('embedding', 'centre')} DESC, vec_id LIMIT 10""",
    "q_topk_batch": f"""
      SELECT query_id, chunk_pos, rank, round(retrieval_score, 6) AS retrieval_score
      FROM ({best('one', 10)})""",
    "q_topk_grouped": f"""
      SELECT query_id, repo_id, chunk_pos, rank, round(retrieval_score, 6) AS retrieval_score
      FROM ({best('label', 5)})""",
    "q_topk_passes": f"""
      SELECT query_id, repo_id, chunk_pos, rank, round(retrieval_score, 6) AS retrieval_score
      FROM ({best('label', 3)})""",
    "q_topk_pruned": f"""
      SELECT query_id, repo_id, chunk_pos, rank, round(retrieval_score, 6) AS retrieval_score
      FROM ({best('label', 10)})""",
    "q_topk_whole_ranking": f"""
      SELECT query_id, repo_id, chunk_pos, rank, round(retrieval_score, 6) AS retrieval_score
      FROM ({best('label', 1000)})""",
    "q_topk_shared_ids": """
      WITH v AS (SELECT label::BIGINT AS repo_id, vec_id AS chunk_pos, embedding::DOUBLE[] AS e,
                        row_number() OVER (PARTITION BY label ORDER BY vec_id) AS query_id
                 FROM embeddings),
      s AS (SELECT q.query_id, repo_id, v.chunk_pos, list_dot_product(v.e, q.e) AS score
            FROM v AS q JOIN v USING (repo_id))
      SELECT query_id, repo_id, chunk_pos, rank, round(score, 6) AS retrieval_score
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id, repo_id
                                         ORDER BY score DESC, chunk_pos) AS rank FROM s)
      WHERE rank <= 3""",
    "q_lookup_positions": """
      SELECT label::BIGINT AS repo_id, vec_id % 40 AS chunk_pos, count(*) AS found
      FROM embeddings WHERE label = 3 AND vec_id % 40 IN (1, 5, 39, 77) GROUP BY 1, 2""",
    "q_normalize": unnested(
        """(SELECT vec_id, raw, sqrt(list_dot_product(raw, raw)) AS n FROM (
              SELECT vec_id, [x::DOUBLE * (vec_id % 9) for x in embedding] AS raw
              FROM embeddings))""",
        "[(CASE WHEN n > 0 THEN x / n ELSE 0 END)::FLOAT for x in raw]",
    ),
    "q_float_cast": unnested("embeddings", "[(x::DOUBLE / 3)::FLOAT for x in embedding]"),
    "q_dim_audit": """
      SELECT label::BIGINT AS repo_id, vec_id AS chunk_pos, 63 AS found_dim
      FROM embeddings WHERE label = 3""",
    "q_vector_stats": """
      SELECT label::BIGINT AS repo_id, count(*) AS vectors, max(len(embedding)) AS dim
      FROM embeddings GROUP BY 1""",
    "q_vector_round_trip": f"""
      SELECT label::BIGINT AS repo_id, vec_id AS chunk_pos, len(embedding) AS dim,
             round({dot('embedding', 'embedding')}, 6) AS own FROM embeddings""",
    "q_rebuild": f"""
      SELECT label::BIGINT AS repo_id, vec_id AS chunk_pos,
             round(sqrt({dot('embedding', 'embedding')}) * CASE WHEN label >= 5 THEN 2 ELSE 1 END, 6)
               AS length
      FROM embeddings""",
    "q_append_positions": """
      WITH p AS (SELECT label::BIGINT AS repo_id, embedding[1] AS x,
                        row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
                        count(*) OVER (PARTITION BY label) AS n FROM embeddings)
      SELECT repo_id, pos AS chunk_pos, round(x::DOUBLE, 6) AS x FROM p
      UNION ALL SELECT repo_id, pos + n, round(x::DOUBLE, 6) FROM p""",
    "q_inner_product": f"""
      SELECT a.vec_id AS chunk_pos, b.vec_id AS next_pos,
             round({dot('a.embedding', 'b.embedding')}, 6) AS score
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "q_positions": """
      SELECT source AS repo, source || '/' || doc_id AS file_path,
             row_number() OVER (PARTITION BY source
               ORDER BY string_split(source || '/' || doc_id, '/')) - 1 AS chunk_pos
      FROM documents""",
    "q_path_order": """
      SELECT page_id, url, row_number() OVER (ORDER BY string_split(url, '/'), page_id) - 1 AS place
      FROM pages""",
    "q_hits_join_docs": f"""
      SELECT query_id, rank, source || '/' || doc_id AS file_path, source AS name,
             'file' AS node_type, round(retrieval_score, 6) AS retrieval_score,
             md5(text) AS snippet_md5
      FROM ({best('one', 10)}) JOIN documents ON doc_id = chunk_pos""",
    "q_hits_orphans": f"""
      SELECT query_id, chunk_pos, rank FROM ({best('one', 10)})
      WHERE chunk_pos NOT IN (SELECT doc_id FROM labels)""",
    "q_semi_lookup": """
      SELECT doc_id AS chunk_pos, source || '/' || doc_id AS file_path, length(text) AS chars
      FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "q_cascade_delete": """
      WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
      SELECT label::BIGINT AS repo_id, vec_id AS chunk_pos FROM embeddings
      WHERE label NOT IN (SELECT label FROM s WHERE n < (SELECT avg(n) FROM s))""",
    "q_empty_repos": """
      SELECT doc_id AS repo_id, source AS path_or_url FROM documents
      WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "q_unknown_repos": """
      SELECT conv_id || '-' || turn AS query_id, conv_id AS repo_id FROM conversations
      WHERE conv_id NOT IN (SELECT doc_id FROM labels)""",
    "q_repo_chunks": """
      SELECT conv_id AS repo_id, 'conv/' || max(turn) OVER (PARTITION BY conv_id) AS path_or_url,
             turn AS chunk_pos, role FROM conversations""",
    "q_null_audit": """
      WITH j AS (SELECT quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
      SELECT c AS column_name,
             CASE c WHEN 'name' THEN (SELECT count(*) FROM j WHERE quality IS NULL)
                    WHEN 'end_line' THEN (SELECT count(*) FROM j WHERE toxic IS DISTINCT FROM 0)
                    ELSE 0 END AS nulls
      FROM (SELECT unnest(['repo_id', 'chunk_pos', 'file_path', 'node_type', 'name', 'start_line',
                           'end_line', 'source_text']) AS c)""",
    "q_duplicate_positions": """
      SELECT label::BIGINT AS repo_id, vec_id // 8 AS chunk_pos, count(*) AS copies
      FROM embeddings GROUP BY 1, 2 HAVING count(*) > 1""",
    "q_distinct_names": """
      SELECT turn AS repo_id, role AS name, count(*) AS chunks FROM conversations GROUP BY 1, 2""",
    "q_new_repos": """
      WITH u AS (SELECT url, row_number() OVER (ORDER BY url) AS n FROM (SELECT DISTINCT url FROM pages))
      SELECT n AS repo_id, url AS path_or_url FROM u
      UNION ALL SELECT n + (SELECT count(*) FROM u), url FROM u""",
    "q_url_class": f"""
      SELECT page_id, {remote('url')} AS url_remote, {remote('bare')} AS bare_remote,
             {remote("('git@' || bare)")} AS ssh_remote, {remote('upper(url)')} AS upper_remote
      FROM (SELECT page_id, url, regexp_replace(url, '^https?://', '') AS bare FROM pages)""",
    "q_ext_filter": f"""
      SELECT p_partkey, path, ext FROM (
        SELECT p_partkey, path, {extension('path')} AS ext
        FROM (SELECT p_partkey, {ODD_PATH} AS path FROM part))
      WHERE ext IN {SOURCE_EXT}""",
    "q_excluded_dirs": f"""
      SELECT p_partkey, path FROM (SELECT p_partkey, {ODD_PATH} AS path FROM part)
      WHERE NOT ({excluded('path')})""",
    "q_language_map": f"""
      SELECT p_partkey, string_split(path, '/')[-1] AS base_name,
             CASE {extension('path')} WHEN '.py' THEN 'python' WHEN '.go' THEN 'go'
               WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' END AS language
      FROM (SELECT p_partkey, {ODD_PATH} AS path FROM part)""",
    "q_source_files": f"""
      SELECT repo_id, path FROM (
        SELECT {REPO} AS repo_id, {CODE_PATH} AS path, true AS valid FROM part
        UNION ALL SELECT 0, {ODD_PATH}, p_partkey % 4 <> 0 FROM part)
      WHERE valid AND {extension('path')} IN {SOURCE_EXT} AND NOT ({excluded('path')})""",
    "q_text_validity": "SELECT doc_id, lang FROM documents WHERE lang <> 'de'",
    "q_corpus_table": """
      SELECT doc_id AS repo_id, source AS path, length(text) AS chars FROM documents""",
    "q_newline_norm": """
      SELECT doc_id, md5(t) AS text_md5, length(t) - length(replace(t, chr(10), '')) + 1 AS lines
      FROM (SELECT doc_id, replace(text, '. ', '.' || chr(10)) AS t FROM documents)""",
    "q_line_count": """
      SELECT doc_id, len(string_split(text, chr(10))) AS lines FROM documents""",
    "q_retrieval_text": """
      SELECT doc_id, md5(t) AS text_md5, length(t) AS chars FROM (
        SELECT doc_id, source || CASE WHEN lang IN ('en', 'fr') THEN '' ELSE chr(10) || lang END
                       || chr(10) || text AS t FROM documents)""",
    "q_utc_minute": """
      SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M UTC') AS minute FROM events""",
    "q_doc_segments": """
      WITH l AS (
        SELECT doc_id, source, text, generate_subscripts(string_split(text, chr(10)), 1) AS i,
               unnest(string_split(text, chr(10))) AS line FROM documents),
      f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS part FROM l
            WHERE regexp_matches(line, '\\S'))
      SELECT doc_id AS repo_id, source AS file_path, part, 'line' AS node_type,
             'line ' || i AS name, i AS start_line, i AS end_line, line AS source_text FROM f
      UNION ALL
      SELECT doc_id, source, 0, 'file', source, 1, len(string_split(text, chr(10))), text
      FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f)""",
    "q_page_elements": f"""
      WITH cut AS (
        SELECT page_id, url, html, list_concat([''], regexp_extract_all(html, {quoted(MARKUP)})) AS tags,
               string_split_regex(html, {quoted(MARKUP)}) AS texts FROM pages),
      steps AS (SELECT page_id, unnest(range(len(tags))) AS i, unnest(tags) AS tag, unnest(texts) AS after FROM cut),
      named AS (SELECT *, lower(regexp_extract(tag, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS name FROM steps),
      kinds AS (SELECT *, list_contains({listed(CONTAINERS)}, name) AS holds,
                       list_contains({listed(PIECES)}, name) AS is_piece, tag LIKE '</%' AS ends FROM named),
      runs AS (
        SELECT *, count(*) FILTER (holds OR is_piece) OVER w AS grp,
               sum(CASE WHEN NOT holds THEN 0 WHEN ends THEN -1 ELSE 1 END) OVER w AS total,
               sum(len(string_split(tag, chr(10))) + len(string_split(after, chr(10))) - 2) OVER w AS line_ends,
               last_value(CASE WHEN holds OR ends AND is_piece OR name = 'hr' THEN '' WHEN is_piece THEN name END
                          IGNORE NULLS) OVER w AS piece
        FROM kinds WINDOW w AS (PARTITION BY page_id ORDER BY i)),
      deep AS (SELECT *, total - least(min(total) OVER (PARTITION BY page_id ORDER BY i), 0) AS depth FROM runs),
      placed AS (
        SELECT *, last_value(CASE WHEN holds AND NOT ends THEN name END IGNORE NULLS)
                    OVER (PARTITION BY page_id, depth ORDER BY i) AS container
        FROM deep),
      joined AS (
        SELECT page_id, grp, string_agg(after, '' ORDER BY i) AS raw,
               arg_min(CASE WHEN piece <> '' THEN piece WHEN depth > 0 THEN coalesce(container, 'page')
                            ELSE 'page' END, i) AS name,
               min(line_ends - len(string_split(after, chr(10))) + 2
                   + len(string_split(regexp_extract(after, '^\\s*'), chr(10))) - 1)
                 FILTER (regexp_matches(regexp_replace(after, '<[^>]*>', '', 'g'), '\\S')) AS start_line,
               max(line_ends + 1 - (len(string_split(regexp_extract(after, '\\s*$'), chr(10))) - 1))
                 FILTER (regexp_matches(regexp_replace(after, '<[^>]*>', '', 'g'), '\\S')) AS end_line
        FROM placed GROUP BY page_id, grp),
      e AS (
        SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY grp) - 1 AS part, name, start_line, end_line,
               regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS source_text
        FROM joined WHERE start_line IS NOT NULL)
      SELECT page_id AS repo_id, part, 'element' AS node_type, name, start_line, end_line, source_text FROM e
      UNION ALL
      SELECT page_id, 0, 'file', string_split(url, '/')[-1], 1,
             len(string_split(html, chr(10))), html
      FROM pages WHERE page_id NOT IN (SELECT page_id FROM e)""",
    "q_page_coverage": """
      WITH plain AS (
        SELECT page_id, regexp_replace(regexp_replace(html,
                 '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]*>',
                 chr(1), 'g'), chr(1) || '+', chr(1), 'g') AS t FROM pages),
      shown AS (SELECT page_id, regexp_replace(t, '[\\s\\x01]+', '', 'g') AS t FROM plain)
      SELECT page_id AS repo_id, length(shown.t) AS chars, 1 AS first_line,
             len(string_split(html, chr(10))) AS last_line
      FROM shown JOIN pages USING (page_id) WHERE shown.t <> ''""",
    "q_turn_chunks": """
      SELECT 0 AS repo_id, conv_id::VARCHAR AS file_path, turn AS part, 'turn' AS node_type,
             role AS name, 1 AS start_line, len(string_split(text, chr(10))) AS end_line,
             text AS source_text FROM conversations""",
    "q_mask_text": " UNION ALL ".join(
        f"""SELECT {CODE_PATH} AS path, {masked(ext)} AS masked
            FROM part WHERE {suffix()} = '{ext}'""" for ext in I.MASKED
    ),
    "q_mask_keeps_length": " UNION ALL ".join(
        f"""SELECT {CODE_PATH} AS path, length({filled(I.TEMPLATES[ext])}) AS masked_chars,
              {I.TEMPLATES[ext].count(chr(10)) + 1} AS masked_lines
            FROM part WHERE {suffix()} = '{ext}'"""
        for ext in (".py", ".go", ".js", ".ts")
    ),
    "q_py_chunks": definition_rows([".py"]),
    "q_brace_chunks": definition_rows([".go", ".js", ".ts"]),
    "q_file_fallback": whole_file_rows(),
    "q_method_labels": f"""
      SELECT repo_id, node_type, name, count(*) AS chunks FROM ({ALL_CHUNKS}) GROUP BY ALL""",
    "q_code_positions": f"""
      SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY string_split(file_path, '/'),
               start_line, end_line DESC) - 1 AS chunk_pos,
             file_path, node_type, name, start_line, end_line FROM ({ALL_CHUNKS})""",
    "q_hash_embed": f"""
      WITH d AS ({DOCS}), v AS ({hashed("d", "chunk_pos", "body")})
      SELECT chunk_pos, b AS bucket, round(embedding[b + 1]::DOUBLE, 6) AS x FROM v, range(64) r(b)""",
    "q_query_embed": f"""
      WITH q AS ({BENCH}), v AS ({hashed("q", "query_id", "text")})
      SELECT query_id, b AS bucket, round(embedding[b + 1]::DOUBLE, 6) AS x FROM v, range(64) r(b)""",
    "q_hash_search": f"""
      {search(DOCS, BENCH)}
      SELECT query_id, chunk_pos, rank, round(retrieval_score, 6) AS retrieval_score FROM hits""",
    "q_term_statistics": f"""
      {search(DOCS, BENCH)}
      SELECT repo_id, t AS term, df AS chunks_with_term FROM df""",
    "q_pair_score": f"""
      {search(DOCS, BENCH)}
      SELECT query_id, file_path, round(score, 6) AS score,
             round(retrieval_score, 6) AS retrieval_score FROM ranked""",
    "q_rerank": f"""
      {search(DOCS, BENCH)}
      SELECT query_id, final_rank AS rank, file_path, round(score, 6) AS score FROM ranked""",
    "q_model_embed": """
      WITH t AS (SELECT doc_id, source || chr(10) || text AS t FROM documents),
      c AS (SELECT doc_id, [length(t), length(t) - length(replace(t, 'a', '')),
                            length(t) - length(replace(t, 'e', '')), 1]::DOUBLE[] AS c FROM t)
      SELECT doc_id AS chunk_pos, b AS bucket,
             round((c[b + 1] / sqrt(list_dot_product(c, c)))::FLOAT::DOUBLE, 6) AS x
      FROM c, range(4) r(b)""",
    "q_model_score": f"""
      {search(DOCS, BENCH)},
      e AS (SELECT h.query_id, h.rank, d.file_path,
                   -abs((length(q.text) - length(replace(q.text, 'e', '')))
                        - (length(d.body) - length(replace(d.body, 'e', ''))))::DOUBLE AS score
            FROM hits h JOIN q USING (query_id) JOIN d USING (chunk_pos))
      SELECT query_id, file_path, score,
             row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM e""",
    "q_stored_vectors": f"""
      SELECT label::BIGINT AS repo_id, vec_id AS chunk_pos, 64 AS dim,
             round({dot('embedding', 'embedding')}, 6) AS own FROM embeddings WHERE label = 3""",
    "q_display_rows": f"""
      {search(DOCS, BENCH)}
      SELECT query_id, final_rank AS rank, printf('%.3f', score) AS score_text,
             name || ' (file)' AS label, file_path || ':1-1' AS location
      FROM ranked WHERE final_rank <= k""",
    "q_search_e2e": f"""
      {search(LANG_DOCS, "SELECT item_id AS query_id, item_id % 4 + 1 AS repo_id, text, 5 AS k FROM benchmark")}
      SELECT query_id, final_rank AS rank, file_path, name, 'file' AS node_type, 1 AS start_line,
             len(string_split(source_text, chr(10))) AS end_line, round(score, 6) AS score,
             md5(source_text) AS snippet_md5
      FROM ranked WHERE final_rank <= k""",
    "q_reindex": f"""
      WITH d AS ({LANG_DOCS}),
      versions AS (
        SELECT 'before' AS version, repo_id, chunk_pos, source_text, body FROM d
        UNION ALL
        SELECT 'after', repo_id, chunk_pos,
               CASE WHEN repo_id IN (1, 3) THEN 'again ' ELSE '' END || source_text,
               name || chr(10) || CASE WHEN repo_id IN (1, 3) THEN 'again ' ELSE '' END || source_text
        FROM d),
      words AS (
        SELECT DISTINCT version, repo_id, chunk_pos, unnest(regexp_extract_all(lower(body), '[a-z0-9_]+', 0)) AS t
        FROM versions),
      terms AS (SELECT version, repo_id, count(DISTINCT t) AS terms, count(*) AS uses FROM words GROUP BY ALL)
      SELECT version, repo_id, 'docs/' || repo_id AS path_or_url, count(*) AS chunks,
             sum(length(source_text))::BIGINT AS chars, count(*) AS vectors,
             sum(chunk_pos)::BIGINT AS positions, any_value(terms) AS terms, any_value(uses) AS uses
      FROM versions JOIN terms USING (version, repo_id) GROUP BY version, repo_id""",
    "q_delete_repos": """
      WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
      SELECT label::BIGINT AS repo_id, 'label/' || label AS path_or_url, vec_id AS chunk_pos FROM embeddings
      WHERE label NOT IN (SELECT label FROM s WHERE n < (SELECT avg(n) FROM s))""",
    "q_index_summary": f"""
      SELECT repo_id, count(*) AS chunks_indexed FROM ({ALL_CHUNKS}) GROUP BY 1""",
    "q_workload": f"""
      {search(DOCS, WORKLOAD)}
      SELECT query_id, final_rank AS rank, file_path, round(score, 6) AS score FROM ranked""",
    "q_floor_percentile": f"""
      SELECT event_type, p29 FROM ({summary('event_type,', EVENT_ROWS, {'p29': 0.29})})""",
    "q_latency_summary": f"""
      SELECT * REPLACE (round(mean, 6) AS mean)
      FROM ({summary('event_type,', EVENT_ROWS, PERCENTILES)})""",
    "q_latency_overall": f"""
      SELECT * REPLACE (round(mean, 4) AS mean) FROM ({summary('', LINE_ROWS, PERCENTILES)})""",
    "q_cyclic_workload": """
      SELECT i AS query_id, item_id AS item, text
      FROM (SELECT unnest(range((SELECT count(*) FROM documents))) AS i)
      JOIN benchmark ON item_id = i % (SELECT count(*) FROM benchmark)""",
}
