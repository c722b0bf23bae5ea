"""DuckDB SQL for each registered query: the correctness oracle.

The CTEs restate the table mapping of ``vellum.sources.tables`` and the
analyzer of ``vellum.functions.text`` in plain SQL, so the oracle shares no
code with the Spark side. Tables ``documents labels nation benchmark events
part conversations`` are the driver's views.
"""

from __future__ import annotations

DOCS = r"""
docs AS (
  SELECT 'D' || lpad(CAST(d.doc_id AS VARCHAR), CAST(greatest(8, length(CAST(d.doc_id AS VARCHAR))) AS INTEGER), '0') AS id,
         'ent-' || d.source AS entity_id,
         d.source AS entity,
         CASE WHEN d.lang = 'en' THEN NULL ELSE d.lang END AS topic,
         'doc-' || CAST(d.doc_id AS VARCHAR) AS name,
         split_part(d.text, chr(10), 1) AS title,
         d.text AS content,
         CASE WHEN l.doc_id IS NULL THEN CAST([] AS VARCHAR[])
              ELSE ['quality-' || CAST(l.quality AS VARCHAR)]
                   || CASE WHEN l.toxic = 1 THEN ['toxic'] ELSE CAST([] AS VARCHAR[]) END
         END AS tags,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id) AS created_at,
         d.doc_id AS doc_num
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""

ENTITIES = r"""
ents AS (
  SELECT 'ent-' || name AS id, name,
         CASE WHEN CAST(regexp_extract(name, '(\d+)$', 1) AS BIGINT) % 2 = 0
              THEN 'knowledge' ELSE 'project' END AS scope,
         description, tags,
         TIMESTAMP '2024-01-01 00:00:00' AS created_at
  FROM (
    SELECT DISTINCT source AS name, 'About ' || source AS description, ['source'] AS tags
    FROM documents
    UNION ALL
    SELECT lower(replace(n_name, '_', '-')), NULL, CAST([] AS VARCHAR[]) FROM nation
  )
)"""

# Analyzer: alphanumeric runs, numbered, tokens of 40+ bytes dropped, lower-cased.
SPLIT = r"'[^\p{L}\p{N}]+'"

FIELD_TEXTS = rf"""
ftexts AS (
  SELECT doc_id, field, toks, len(list_filter(toks, lambda x: strlen(x) < 40)) AS dl
  FROM (
    SELECT doc_id, field, list_filter(regexp_split_to_array(coalesce(text, ''), {SPLIT}), lambda x: x <> '') AS toks
    FROM (
      SELECT id AS doc_id, 'title' AS field, title AS text FROM docs
      UNION ALL SELECT id, 'content', content FROM docs
      UNION ALL SELECT id, 'tags', array_to_string(tags, ' ') FROM docs
    )
  )
),
tok AS (
  SELECT doc_id, field, pos, lower(t) AS term FROM (
    SELECT doc_id, field, unnest(toks) AS t, generate_subscripts(toks, 1) - 1 AS pos FROM ftexts
  ) WHERE strlen(t) < 40
),
postings AS (
  SELECT field, term, doc_id, count(*) AS tf, list(pos ORDER BY pos) AS positions
  FROM tok GROUP BY field, term, doc_id
),
rawpost AS (
  SELECT 'entity' AS field, entity AS term, id AS doc_id FROM docs
  UNION ALL SELECT 'topic', coalesce(topic, ''), id FROM docs
  UNION ALL SELECT 'name', name, id FROM docs
  UNION ALL SELECT 'id', id, id FROM docs
),
dls AS (SELECT doc_id, field, dl FROM ftexts),
corpus AS (SELECT field, count(*) AS n_docs, avg(dl) AS avgdl FROM ftexts GROUP BY field),
n_all AS (SELECT max(n_docs) AS n FROM corpus),
dfs AS (
  SELECT field, term, count(*) AS df FROM postings GROUP BY field, term
  UNION ALL SELECT field, term, count(*) FROM rawpost GROUP BY field, term
)"""

QTERMS = rf"""
qtok AS (
  SELECT item_id AS query_id, t, pos FROM (
    SELECT item_id, unnest(toks) AS t, generate_subscripts(toks, 1) AS pos FROM (
      SELECT item_id, list_filter(regexp_split_to_array(coalesce(text, ''), {SPLIT}), lambda x: x <> '') AS toks
      FROM benchmark))
  WHERE strlen(t) < 40
),
qterms AS (
  SELECT query_id, clause_no, term FROM (
    SELECT query_id, lower(t) AS term,
           row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS clause_no
    FROM qtok)
)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def bm25_sql(weight: str, tf: str, dl: str, avgdl: str) -> str:
    return f"({weight}) * 2.2 * ({tf}) / (({tf}) + 1.2 * (0.25 + 0.75 * ({dl}) / ({avgdl})))"


IDF = "ln(1 + (n.n - s.df + 0.5) / (s.df + 0.5))"

TERM_SCORES = rf"""
fields AS (SELECT unnest(['title', 'content', 'tags']) AS field),
qf AS (SELECT q.query_id, q.clause_no, q.term, f.field FROM qterms q, fields f),
scored AS (
  SELECT q.query_id, q.clause_no, p.doc_id,
         {bm25_sql(IDF, 'p.tf', 'd.dl', 'c.avgdl')} AS score
  FROM qf q
  JOIN postings p ON p.field = q.field AND p.term = q.term
  JOIN dfs s ON s.field = q.field AND s.term = q.term
  JOIN dls d ON d.doc_id = p.doc_id AND d.field = p.field
  JOIN corpus c ON c.field = q.field, n_all n
)"""


def topk_sql(source: str, k: str = "10") -> str:
    return f"""
SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, score FROM (
  SELECT query_id, doc_id, round(score, 6) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank
  FROM {source})
WHERE rank <= {k}"""


ORACLE: dict[str, str] = {}

ORACLE["search_bm25"] = (
    with_ctes(DOCS, FIELD_TEXTS, QTERMS, TERM_SCORES,
              "agg AS (SELECT query_id, doc_id, sum(score) AS score FROM scored GROUP BY 1, 2)")
    + topk_sql("agg"))

# ------------------------------------------------------------------ metadata

RFC = "'%Y-%m-%dT%H:%M:%S.%fZ'"
SEG = "'[a-z0-9-]+'"


def valid_path_sql(e: str, t: str, n: str) -> str:
    return (f"(coalesce(regexp_full_match({e}, {SEG}), false) AND ({t} IS NULL OR "
            f"coalesce(regexp_full_match({t}, {SEG}), false)) AND coalesce(regexp_full_match({n}, {SEG}), false))")


ENTITY_KEYS = "ekeys AS (SELECT name AS key FROM ents UNION ALL SELECT name || '-x' FROM ents)"

CHANGES = rf"""
ch AS (
  SELECT e.event_id AS seq, e.ts,
         CASE WHEN e.event_type = 'signup' THEN 'save' WHEN e.event_type = 'error' THEN 'delete' ELSE 'update' END AS op,
         CASE WHEN e.event_type = 'signup' THEN 'E' || CAST(e.event_id AS VARCHAR)
              WHEN e.event_id % 2 = 0 THEN 'D' || lpad(CAST(e.event_id % c.n AS VARCHAR), CAST(greatest(8, length(CAST(e.event_id % c.n AS VARCHAR))) AS INTEGER), '0')
              ELSE 'E' || CAST(e.event_id - 7 AS VARCHAR) END AS id,
         CASE WHEN e.event_type = 'signup' THEN 'src' || CAST(e.user_id % 25 AS VARCHAR) END AS entity,
         CASE WHEN e.event_type = 'signup' THEN
              CASE WHEN e.user_id % 10 = 9 THEN 'Bad_Topic' WHEN e.user_id % 10 < 3 THEN 'fr'
                   WHEN e.user_id % 10 < 5 THEN 'de' END END AS topic,
         CASE WHEN e.event_type = 'signup' THEN 'evt-' || CAST(e.event_id % 500 AS VARCHAR) END AS name,
         CASE WHEN e.event_type IN ('signup', 'click') THEN 'Title ' || CAST(e.event_id AS VARCHAR) END AS title,
         CASE WHEN e.event_type IN ('signup', 'view') THEN e.props || ' ' || CAST(e.value AS VARCHAR) END AS content,
         CASE WHEN e.event_type = 'signup' THEN ['new']
              WHEN e.event_type = 'purchase' THEN ['purchase', 'v' || CAST(CAST(floor(e.value) AS BIGINT) AS VARCHAR)]
         END AS tags
  FROM events e, (SELECT count(*) AS n FROM documents) c
)"""

DOC_KEYS = "dkeys AS (SELECT DISTINCT id AS key FROM ch WHERE op <> 'save')"

COUNTS = """
counts AS (
  SELECT e.name AS entity, c.topic, CAST(coalesce(c.n, 0) AS BIGINT) AS document_count
  FROM ents e LEFT JOIN (SELECT entity_id, topic, count(id) AS n FROM docs GROUP BY entity_id, topic) c
    ON c.entity_id = e.id
)"""

TREE = """
tree AS (
  SELECT entity, CAST(sum(document_count) AS BIGINT) AS document_count,
         list(struct_pack(name := topic, document_count := document_count) ORDER BY topic)
           FILTER (WHERE topic IS NOT NULL) AS children
  FROM counts GROUP BY entity
)"""

CHILDREN_TEXT = "coalesce(array_to_string(list_transform(children, lambda x: x.name || '=' || CAST(x.document_count AS VARCHAR)), ','), '')"

ORACLE["list_entities"] = with_ctes(ENTITIES) + f"""
SELECT id, name, scope, description, array_to_string(tags, ',') AS tags,
       regexp_replace(strftime(created_at, {RFC}), '([.]000000|000)Z$', 'Z') AS created_at FROM ents ORDER BY name"""

ORACLE["entity_by_name"] = with_ctes(ENTITIES, ENTITY_KEYS) + """
SELECT k.key, e.id, e.scope, e.description FROM ekeys k LEFT JOIN ents e ON e.name = k.key"""

ORACLE["docs_with_entity"] = with_ctes(DOCS, ENTITIES) + """
SELECT d.id, d.name, d.entity_id, e.name AS entity_name, e.scope FROM docs d JOIN ents e ON e.id = d.entity_id"""

ORACLE["doc_by_id"] = with_ctes(DOCS, ENTITIES, CHANGES, DOC_KEYS) + f"""
SELECT k.key, d.name, d.entity, d.topic, d.title, array_to_string(d.tags, ',') AS tags, e.scope,
       regexp_replace(strftime(d.created_at, {RFC}), '([.]000000|000)Z$', 'Z') AS created_at
FROM dkeys k LEFT JOIN (docs d JOIN ents e ON e.id = d.entity_id) ON d.id = k.key"""

ORACLE["validate_scope"] = """
SELECT event_id AS seq, 'user-' || CAST(user_id AS VARCHAR) AS name,
       CASE event_type WHEN 'click' THEN 'knowledge' WHEN 'view' THEN 'project'
                       WHEN 'purchase' THEN 'Project' ELSE event_type END AS scope,
       CASE event_type WHEN 'click' THEN true WHEN 'view' THEN true ELSE false END AS valid
FROM events"""

ORACLE["validate_paths"] = with_ctes(DOCS, """
cand AS (
  SELECT entity, topic, name FROM docs
  UNION ALL
  SELECT lower(replace(p_brand, '#', '-')),
         CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN lower(p_type) ELSE p_type END,
         CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '-') ELSE p_name END
  FROM part
)""") + f"""
SELECT entity, topic, name, {valid_path_sql('entity', 'topic', 'name')} AS valid,
       concat_ws('/', entity, topic, name) AS path FROM cand"""

ORACLE["doc_paths"] = with_ctes(DOCS) + """
SELECT id, 'entities/' || concat_ws('/', entity, topic, name) || '.md' AS fs_path,
       concat_ws('/', entity, topic, name) AS display_path,
       concat_ws('/', entity, topic) AS hit_path, true AS round_trip FROM docs"""

ORACLE["name_available"] = with_ctes(DOCS, """
cand AS (
  SELECT DISTINCT candidate FROM (
    SELECT 'doc-' || CAST(user_id AS VARCHAR) AS candidate FROM events
    UNION ALL SELECT 'evt-' || CAST(event_id % 500 AS VARCHAR) FROM events)
)""") + """
SELECT candidate, candidate NOT IN (SELECT name FROM docs) AS available FROM cand"""

ORACLE["tree_counts"] = with_ctes(DOCS, ENTITIES, COUNTS) + """
SELECT entity, topic, document_count FROM counts ORDER BY entity, topic NULLS FIRST"""

ORACLE["tree_rollup"] = with_ctes(DOCS, ENTITIES, COUNTS) + """
SELECT entity, topic, CAST(0 AS BIGINT) AS level, document_count FROM counts
UNION ALL
SELECT entity, NULL, CAST(1 AS BIGINT), CAST(sum(document_count) AS BIGINT) FROM counts GROUP BY entity"""

ORACLE["tree_nested"] = with_ctes(DOCS, ENTITIES, COUNTS, TREE) + f"""
SELECT entity, document_count, {CHILDREN_TEXT} AS children FROM tree"""

ORACLE["tree_depth1"] = with_ctes(DOCS, ENTITIES, COUNTS) + """
SELECT entity, CAST(sum(document_count) AS BIGINT) AS document_count, CAST(0 AS BIGINT) AS n_children
FROM counts GROUP BY entity"""

ORACLE["tree_entity"] = with_ctes(DOCS, ENTITIES, COUNTS, TREE, ENTITY_KEYS) + f"""
SELECT k.key AS entity, coalesce(t.document_count, 0) AS document_count, {CHILDREN_TEXT} AS children
FROM ekeys k LEFT JOIN tree t ON t.entity = k.key"""

ORACLE["tree_text"] = with_ctes(DOCS, ENTITIES, COUNTS, TREE) + """
SELECT entity,
       array_to_string(list_concat([entity || '/  (' || CAST(document_count AS VARCHAR) || ' documents)'],
         coalesce(list_transform(children, lambda x: '  ' || x.name || '/  (' || CAST(x.document_count AS VARCHAR) || ' documents)'), [])),
         chr(10)) AS text
FROM tree"""

ORACLE["tree_json"] = with_ctes(DOCS, ENTITIES, COUNTS, TREE) + """
SELECT entity, CAST(json_object('name', entity, 'document_count', document_count, 'children',
       coalesce(list_transform(children, lambda x: json_object('name', x.name, 'document_count', x.document_count,
                'children', json('[]'))), [])) AS VARCHAR) AS json
FROM tree"""

ORACLE["rebuild_count"] = "SELECT count(*) AS n_documents FROM documents"

ORACLE["corpus_all"] = with_ctes(DOCS) + r"""
SELECT id, entity, topic, name, CAST(length(body) AS BIGINT) AS n_chars, md5(body) AS content_md5
FROM (SELECT *, regexp_replace(content, '^\n+', '') AS body FROM docs WHERE doc_num % 7 <> 3)
ORDER BY entity, topic NULLS FIRST, name"""

ORACLE["vault_rejects"] = with_ctes(DOCS) + """
SELECT 'entities/' || CASE WHEN way = 10 THEN 'x' ELSE '' END || concat_ws('/', entity, topic,
         CASE WHEN way = 9 THEN replace(name, 'doc-', 'Doc_') ELSE name END) || '.md' AS path,
       CASE way WHEN 1 THEN 'missing_frontmatter' WHEN 2 THEN 'unclosed_frontmatter' WHEN 3 THEN 'invalid_created_at'
                WHEN 4 THEN 'missing_title' WHEN 5 THEN 'title_not_a_string' WHEN 6 THEN 'tags_not_a_list'
                WHEN 7 THEN 'duplicate_id' WHEN 8 THEN 'unclosed_quotes_title' WHEN 9 THEN 'invalid_path' ELSE 'not_found' END AS reason
FROM (SELECT *, doc_num % 12 AS way FROM docs) WHERE way BETWEEN 1 AND 10"""

# ------------------------------------------------------------------ changes

NEVER = 2**62


def apply_sql(op_filter: str, select: str) -> str:
    """The change log applied one change at a time: a recursive fold per name
    for saves; lifetimes for updates and deletes."""
    return "WITH RECURSIVE " + ",".join([DOCS, ENTITIES, CHANGES, f"""
chf AS (SELECT * FROM ch WHERE {op_filter}),
dels AS (SELECT seq, id FROM chf WHERE op = 'delete'),
ups AS (SELECT * FROM chf WHERE op = 'update'),
sv AS (SELECT chf.*, e.id AS entity_id FROM chf LEFT JOIN ents e ON e.name = chf.entity WHERE chf.op = 'save'),
base AS (
  SELECT d.*, coalesce(m.death, {NEVER}) AS death FROM docs d
  LEFT JOIN (SELECT id, min(seq) AS death FROM dels GROUP BY id) m ON m.id = d.id
),
s2 AS (
  SELECT sv.*, {valid_path_sql('sv.entity', 'sv.topic', 'sv.name')} AS path_ok,
         coalesce((SELECT min(x.seq) FROM dels x WHERE x.id = sv.id AND x.seq > sv.seq), {NEVER}) AS death
  FROM sv WHERE entity_id IS NOT NULL
),
ordered AS (
  SELECT s2.seq, s2.name, s2.path_ok, s2.death,
         row_number() OVER (PARTITION BY s2.name ORDER BY s2.seq) AS rn,
         coalesce(b.death, -1) AS d0
  FROM s2 LEFT JOIN base b ON b.name = s2.name
),
fold(name, rn, hd, seq, status) AS (
  SELECT name, rn,
         CASE WHEN seq < d0 OR NOT path_ok THEN d0 ELSE death END,
         seq,
         CASE WHEN seq < d0 THEN 'duplicate_name' WHEN NOT path_ok THEN 'invalid_path' ELSE 'accepted' END
  FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.name, o.rn,
         CASE WHEN o.seq < f.hd OR NOT o.path_ok THEN f.hd ELSE o.death END,
         o.seq,
         CASE WHEN o.seq < f.hd THEN 'duplicate_name' WHEN NOT o.path_ok THEN 'invalid_path' ELSE 'accepted' END
  FROM fold f JOIN ordered o ON o.name = f.name AND o.rn = f.rn + 1
),
acc AS (SELECT s2.* FROM s2 JOIN fold f ON f.seq = s2.seq WHERE f.status = 'accepted'),
lives AS (
  SELECT id, entity, topic, name, title, content, tags, created_at, created_at AS updated_at,
         CAST(-1 AS BIGINT) AS birth, death FROM base
  UNION ALL
  SELECT id, entity, topic, name, coalesce(title, ''), coalesce(content, ''), coalesce(tags, CAST([] AS VARCHAR[])),
         ts, ts, seq, death FROM acc
),
gu AS (SELECT u.* FROM ups u JOIN lives l ON l.id = u.id WHERE l.birth < u.seq AND u.seq < l.death),
patch AS (
  SELECT id, arg_max(title, seq) FILTER (WHERE title IS NOT NULL) AS p_title,
         arg_max(content, seq) FILTER (WHERE content IS NOT NULL) AS p_content,
         arg_max(tags, seq) FILTER (WHERE tags IS NOT NULL) AS p_tags,
         max(ts) AS p_ts
  FROM gu GROUP BY id
),
final AS (
  SELECT l.id, l.entity, l.topic, l.name, coalesce(p.p_title, l.title) AS title,
         coalesce(p.p_content, l.content) AS content, coalesce(p.p_tags, l.tags) AS tags,
         l.created_at, coalesce(p.p_ts, l.updated_at) AS updated_at
  FROM lives l LEFT JOIN patch p ON p.id = l.id WHERE l.death >= {NEVER}
),
rejects AS (
  SELECT seq, 'not_found' AS reason, entity AS detail FROM sv WHERE entity_id IS NULL
  UNION ALL SELECT f.seq, f.status, f.name FROM fold f WHERE f.status <> 'accepted'
  UNION ALL SELECT d.seq, 'not_found', d.id FROM dels d LEFT JOIN lives l ON l.id = d.id
            WHERE NOT coalesce(l.birth < d.seq AND d.seq = l.death, false)
  UNION ALL SELECT u.seq, 'not_found', u.id FROM ups u LEFT JOIN lives l ON l.id = u.id
            WHERE NOT coalesce(l.birth < u.seq AND u.seq < l.death, false)
)"""]) + select


DOC_OUT = f"""
SELECT id, entity, topic, name, title, md5(content) AS content_md5, array_to_string(tags, ',') AS tags,
       regexp_replace(strftime(created_at, {RFC}), '([.]000000|000)Z$', 'Z') AS created_at, regexp_replace(strftime(updated_at, {RFC}), '([.]000000|000)Z$', 'Z') AS updated_at FROM final"""

ORACLE["apply_changes"] = apply_sql("true", DOC_OUT)
ORACLE["apply_changes_rejects"] = apply_sql("true", "SELECT seq, reason, detail FROM rejects")
ORACLE["save_batch"] = apply_sql("op = 'save'", DOC_OUT)
ORACLE["save_batch_rejects"] = apply_sql("op = 'save'", "SELECT seq, reason, detail FROM rejects")
ORACLE["update_batch"] = apply_sql("op = 'update'", DOC_OUT)
ORACLE["delete_batch"] = apply_sql("op = 'delete'", "SELECT id, name FROM final")

ORACLE["save_entity_exists"] = with_ctes(DOCS, ENTITIES, CHANGES) + """
SELECT c.seq, c.entity, c.entity IN (SELECT name FROM ents) AS exists FROM ch c WHERE c.op = 'save'"""

ORACLE["save_name_unique"] = with_ctes(DOCS, CHANGES) + """
SELECT seq, name FROM ch WHERE op = 'save' AND name NOT IN (SELECT name FROM docs)"""

# ------------------------------------------------------------------ search forms

# All words of each text; t0 to t4 are the word of a place and those behind it.
PLACES_SQL = """
qw AS (
  SELECT query_id, clause_no AS place, term AS t0,
         lead(term, 1) OVER w AS t1, lead(term, 2) OVER w AS t2, lead(term, 4) OVER w AS t4
  FROM qterms WINDOW w AS (PARTITION BY query_id ORDER BY clause_no)
),
qlist AS (SELECT item_id AS query_id, coalesce(l.terms, CAST([] AS VARCHAR[])) AS terms FROM benchmark
          LEFT JOIN (SELECT query_id, list(term ORDER BY clause_no) AS terms FROM qterms GROUP BY query_id) l ON l.query_id = item_id),
qsorted AS (
  SELECT query_id, row_number() OVER w - 1 AS place, term AS t0, lead(term) OVER w AS t1
  FROM (SELECT DISTINCT query_id, term FROM qterms) WINDOW w AS (PARTITION BY query_id ORDER BY term)
)"""

HERE = "query_id * 1048576 + place"


def clause_sql(source, query, no, kind, terms, occur="should", field="NULL", slop="NULL", boost="1.0",
               entity="NULL", k="10"):
    terms = f"[{', '.join(terms)}]::VARCHAR[]" if isinstance(terms, list) else terms
    return (f"SELECT {query} AS query_id, {no} AS clause_no, '{occur}' AS occur, '{kind}' AS kind, "
            f"CAST({field} AS VARCHAR) AS field, {terms} AS terms, "
            f"CAST({slop} AS INTEGER) AS slop, CAST({boost} AS DOUBLE) AS boost, "
            f"CAST({entity} AS VARCHAR) AS entity, {k} AS k FROM {source}")


PAIRS = "qw WHERE t1 IS NOT NULL"
FORMS = {
    "term": [clause_sql("qw", HERE, 0, "term", ["t0"])],
    "and": [clause_sql(PAIRS, HERE, 0, "term", ["t0"], "must"), clause_sql(PAIRS, HERE, 1, "term", ["t1"], "must")],
    "not": [clause_sql(PAIRS, HERE, 0, "term", ["t0"]), clause_sql(PAIRS, HERE, 1, "term", ["t1"], "must_not")],
    "phrase": [clause_sql("qw", HERE, 0, "phrase", ["t0", "t1"])],
    "phrase_slop": [clause_sql("qw", HERE, 0, "phrase", ["t0", "t2", "t4"], slop="2")],
    "field": [clause_sql("qw", "query_id", "place", "term", ["t0"],
                         field="CASE WHEN place % 2 = 0 THEN 'title' ELSE 'content' END")],
    "exact": [clause_sql("qlist", "query_id", 0, "exact", ["'doc-' || CAST(query_id * 7 AS VARCHAR)"], field="'name'"),
              clause_sql("qw", "query_id", "place + 1", "term", ["t0"])],
    "boost": [clause_sql("qw", "query_id", "place", "term", ["t0"],
                         boost="CASE place % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 1.0 ELSE 0.5 END")],
    "entity": [clause_sql("qw", "query_id", "place", "term", ["t0"], entity="'src' || CAST(query_id % 20 AS VARCHAR)")],
    "set": [clause_sql("qlist WHERE len(terms) > 0", "query_id", 0, "set", "terms")],
    "range": [clause_sql("qsorted", "query_id", "place", "range", ["t0", "t1"])],
    "prefix": [clause_sql("qw", HERE, 0, "prefix", ["substr(t0, 1, 3)"])],
    "phrase_prefix": [clause_sql("qw", HERE, 0, "prefix", ["t0", "substr(t1, 1, 2)"])],
    "all": [clause_sql("qlist", "query_id", 0, "all", []), clause_sql("qw", "query_id", "place + 1", "term", ["t0"])],
}

IDF_OF = "ln(1 + (n.n - coalesce(s.df, 0) + 0.5) / (coalesce(s.df, 0) + 0.5))"

ENGINE = rf"""
clauses AS (
  SELECT * FROM clauses0 WHERE list_bool_and(list_transform(terms, lambda x: x IS NOT NULL)) IS NOT false
  UNION ALL
  SELECT DISTINCT query_id, -1, 'filter', 'exact', 'entity', [entity], NULL, 1.0, entity, NULL
  FROM clauses0 WHERE entity IS NOT NULL
),
cf AS (
  SELECT c.*, unnest(CASE WHEN field IS NULL THEN ['title', 'content', 'tags'] ELSE [field] END) AS f
  FROM clauses c WHERE kind <> 'all'
),
allpost AS (
  SELECT field, term, doc_id, tf, positions FROM postings
  UNION ALL SELECT field, term, doc_id, 1, [0] FROM rawpost
),
alldl AS (SELECT doc_id, field, dl FROM dls UNION ALL SELECT doc_id, field, 1 FROM rawpost),
corp AS (SELECT field, avgdl FROM corpus UNION ALL SELECT unnest(['id', 'entity', 'topic', 'name']), 1.0),
tm AS (
  SELECT c.query_id, c.clause_no, c.occur, p.doc_id,
         {bm25_sql('c.boost * ' + IDF_OF, 'p.tf', 'd.dl', 'k.avgdl')} AS score
  FROM cf c JOIN allpost p ON p.field = c.f AND p.term = c.terms[1]
  LEFT JOIN dfs s ON s.field = c.f AND s.term = c.terms[1]
  JOIN alldl d ON d.doc_id = p.doc_id AND d.field = c.f
  JOIN corp k ON k.field = c.f, n_all n
  WHERE c.kind IN ('term', 'exact')
),
pt AS (
  SELECT query_id, clause_no, occur, boost, f, coalesce(slop, 0) AS slop, len(terms) AS n,
         unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS off
  FROM cf WHERE kind = 'phrase'
),
pidf AS (
  SELECT t.query_id, t.clause_no, t.f, sum({IDF_OF}) AS idf_sum
  FROM pt t LEFT JOIN dfs s ON s.field = t.f AND s.term = t.term, n_all n
  GROUP BY t.query_id, t.clause_no, t.f
),
ppos AS (
  SELECT t.query_id, t.clause_no, t.occur, t.boost, t.f, t.n, t.off, t.slop, p.doc_id,
         unnest(p.positions) AS pos
  FROM pt t JOIN allpost p ON p.field = t.f AND p.term = t.term
),
pf0 AS (
  SELECT query_id, clause_no, occur, boost, f, doc_id, count(*) AS pf FROM (
    SELECT query_id, clause_no, occur, boost, f, doc_id, pos - off AS start
    FROM ppos WHERE slop = 0
    GROUP BY query_id, clause_no, occur, boost, f, doc_id, pos - off
    HAVING count(*) = max(n))
  GROUP BY query_id, clause_no, occur, boost, f, doc_id
),
psl AS (
  SELECT query_id, clause_no, occur, boost, f, doc_id, slop, n, list(pos) FILTER (WHERE off = 0) AS p0,
         list(pos) FILTER (WHERE off = 1) AS p1, list(pos) FILTER (WHERE off = 2) AS p2
  FROM ppos WHERE slop > 0 GROUP BY query_id, clause_no, occur, boost, f, doc_id, slop, n
),
pf1 AS (
  SELECT query_id, clause_no, occur, boost, f, doc_id,
         CASE WHEN n = 2 THEN len(list_filter(p1, lambda e: e - list_max(list_filter(p0, lambda x: x < e)) <= 1 + slop))
              ELSE len(list_filter(p2, lambda e: e - list_max(list_filter(p0, lambda x: x < list_max(list_filter(p1, lambda y: y < e)))) <= 2 + slop))
         END AS pf
  FROM psl
),
pm AS (
  SELECT x.query_id, x.clause_no, x.occur, x.doc_id,
         {bm25_sql('x.boost * i.idf_sum', 'x.pf', 'd.dl', 'k.avgdl')} AS score
  FROM (SELECT * FROM pf0 UNION ALL SELECT * FROM pf1 WHERE pf > 0) x
  JOIN pidf i ON i.query_id = x.query_id AND i.clause_no = x.clause_no AND i.f = x.f
  JOIN alldl d ON d.doc_id = x.doc_id AND d.field = x.f
  JOIN corp k ON k.field = x.f
),
vocab AS (SELECT field, term FROM dfs),
cx AS (
  SELECT query_id, clause_no, occur, f, boost, unnest(terms) AS term FROM cf WHERE kind = 'set'
  UNION ALL
  SELECT c.query_id, c.clause_no, c.occur, c.f, c.boost, v.term
  FROM (SELECT * FROM cf WHERE kind = 'range') c JOIN vocab v ON v.field = c.f AND v.term >= c.terms[1] AND v.term <= c.terms[2]
  UNION ALL
  SELECT c.query_id, c.clause_no, c.occur, c.f, c.boost, v.term
  FROM (SELECT * FROM cf WHERE kind = 'prefix' AND len(terms) = 1) c JOIN vocab v ON v.field = c.f AND starts_with(v.term, c.terms[1])
),
cm AS (
  SELECT DISTINCT c.query_id, c.clause_no, c.occur, c.f, p.doc_id, c.boost AS score
  FROM cx c JOIN allpost p ON p.field = c.f AND p.term = c.term
),
ppre AS (
  SELECT query_id, clause_no, occur, boost, f, len(terms) AS n,
         unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS off
  FROM cf WHERE kind = 'prefix' AND len(terms) > 1
),
pprepos AS (
  SELECT t.query_id, t.clause_no, t.occur, t.boost, t.f, t.n, t.off, p.doc_id, unnest(p.positions) AS pos
  FROM ppre t JOIN allpost p ON p.field = t.f
   AND ((t.off < t.n - 1 AND p.term = t.term) OR (t.off = t.n - 1 AND starts_with(p.term, t.term)))
),
ppm AS (
  SELECT DISTINCT query_id, clause_no, occur, f, doc_id, boost AS score FROM (
    SELECT query_id, clause_no, occur, boost, f, doc_id, pos - off AS start
    FROM pprepos GROUP BY query_id, clause_no, occur, boost, f, doc_id, pos - off
    HAVING count(*) = max(n))
),
am AS (
  SELECT c.query_id, c.clause_no, c.occur, d.id AS doc_id, c.boost AS score
  FROM clauses c, docs d WHERE c.kind = 'all'
),
m AS (
  SELECT query_id, clause_no, occur, doc_id, score FROM tm
  UNION ALL SELECT query_id, clause_no, occur, doc_id, score FROM pm
  UNION ALL SELECT query_id, clause_no, occur, doc_id, score FROM cm
  UNION ALL SELECT query_id, clause_no, occur, doc_id, score FROM am
  UNION ALL SELECT query_id, clause_no, occur, doc_id, score FROM ppm
),
per_doc AS (
  SELECT query_id, doc_id,
         sum(CASE WHEN occur <> 'must_not' THEN score END) AS score,
         count(DISTINCT CASE WHEN occur = 'must' THEN clause_no END) AS must_hit,
         max(CASE WHEN occur = 'filter' THEN 1 ELSE 0 END) AS filter_hit,
         max(CASE WHEN occur = 'should' THEN 1 ELSE 0 END) AS should_hit,
         max(CASE WHEN occur = 'must_not' THEN 1 ELSE 0 END) AS not_hit
  FROM m GROUP BY query_id, doc_id
),
info AS (
  SELECT query_id, count(DISTINCT CASE WHEN occur = 'must' THEN clause_no END) AS n_must,
         max(CASE WHEN entity IS NOT NULL THEN 1 ELSE 0 END) AS has_filter,
         coalesce(max(k), 10) AS k
  FROM clauses0 WHERE list_bool_and(list_transform(terms, lambda x: x IS NOT NULL)) IS NOT false
  GROUP BY query_id
),
matched AS (
  SELECT p.query_id, p.doc_id, p.score, i.k FROM per_doc p JOIN info i ON i.query_id = p.query_id
  WHERE p.must_hit = i.n_must AND p.filter_hit >= i.has_filter AND p.not_hit = 0
    AND (i.n_must > 0 OR p.should_hit = 1)
)"""


def search_sql(clauses0: str) -> str:
    return with_ctes(DOCS, FIELD_TEXTS, QTERMS, PLACES_SQL, f"clauses0 AS ({clauses0})", ENGINE)


def topk_matched_sql() -> str:
    return """
SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, score FROM (
  SELECT query_id, doc_id, round(score, 6) AS score, k,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank
  FROM matched)
WHERE rank <= k"""


for _key, _form in [("search_term", "term"), ("search_all_terms", "and"), ("search_not", "not"),
                    ("search_phrase", "phrase"), ("search_phrase_slop", "phrase_slop"),
                    ("search_field", "field"), ("search_exact", "exact"), ("search_boost", "boost"),
                    ("search_entity_filter", "entity"), ("search_term_set", "set"),
                    ("search_term_range", "range"), ("search_prefix", "prefix"),
                    ("search_phrase_prefix", "phrase_prefix"), ("search_all", "all")]:
    ORACLE[_key] = search_sql(" UNION ALL ".join(FORMS[_form])) + topk_matched_sql()

WHITE_SPACE = r"'[ \t\n\x0B\f\r]+'"
ORACLE["search_text"] = search_sql(rf"""
SELECT query_id, clause_no, 'should' AS occur, CASE WHEN len(terms) > 1 THEN 'phrase' ELSE 'term' END AS kind,
       CAST(NULL AS VARCHAR) AS field, terms, CAST(NULL AS INTEGER) AS slop, CAST(1.0 AS DOUBLE) AS boost, entity, k
FROM (SELECT query_id, entity, k, clause_no,
             list_transform(list_filter(regexp_split_to_array(word, {SPLIT}), lambda x: x <> '' AND strlen(x) < 40), lambda x: lower(x)) AS terms
      FROM (SELECT query_id, entity, k, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS clause_no
            FROM (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'src' || CAST(item_id % 20 AS VARCHAR) END AS entity,
                         CAST(item_id % 7 + 3 AS INTEGER) AS k,
                         regexp_split_to_array(coalesce(CASE WHEN item_id % 2 = 1 THEN regexp_replace(text, '^([^ ]+) ([^ ]+)', '\1-\2') ELSE text END, ''),
                                               {WHITE_SPACE}) AS ws FROM benchmark)))
WHERE len(terms) > 0""") + topk_matched_sql()

ORACLE["search_topk"] = (
    with_ctes(DOCS, FIELD_TEXTS, QTERMS, TERM_SCORES,
              "agg AS (SELECT query_id, doc_id, sum(score) AS score FROM scored GROUP BY 1, 2)")
    + topk_sql("agg", "3"))

ORACLE["search_single"] = search_sql(
    "SELECT 0 AS query_id, term AS clause_no, 'should' AS occur, 'term' AS kind, "
    "CAST(NULL AS VARCHAR) AS field, [term] AS terms, CAST(NULL AS INTEGER) AS slop, 1.0 AS boost, "
    "CAST(NULL AS VARCHAR) AS entity, 10 AS k FROM (SELECT DISTINCT term FROM qterms)") .replace(
        "SELECT DISTINCT query_id, -1, 'filter'", "SELECT DISTINCT query_id, '-1', 'filter'") + """
SELECT doc_id, round(score, 6) AS score FROM matched ORDER BY round(score, 6) DESC, doc_id LIMIT 10"""

# ------------------------------------------------------------------ hits

RANKED = (with_ctes(DOCS, FIELD_TEXTS, QTERMS, TERM_SCORES,
                    "agg AS (SELECT query_id, doc_id, sum(score) AS score FROM scored GROUP BY 1, 2)")
          + ", ranked AS (" + topk_sql("agg") + ")")

ORACLE["search_hits"] = RANKED + """
SELECT r.query_id, r.rank, r.doc_id, d.entity, d.topic, d.name, d.title,
       array_to_string(d.tags, ',') AS tags, r.score
FROM ranked r JOIN docs d ON d.id = r.doc_id"""

SNIPPETS = "WITH RECURSIVE " + RANKED[len("WITH "):] + r""",
qw AS (
  SELECT DISTINCT q.query_id, q.term, 1.0 / (1 + coalesce(s.df, 0)) AS w
  FROM qterms q LEFT JOIN dfs s ON s.field = 'content' AND s.term = q.term
),
hd AS (SELECT DISTINCT r.doc_id, d.content FROM ranked r JOIN docs d ON d.id = r.doc_id),
tk AS (
  SELECT doc_id, i, t,
         CAST(coalesce(sum(length(t) + coalesce(length(s), 0)) OVER (
           PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st
  FROM (SELECT doc_id, unnest(toks) AS t, unnest(seps) AS s, generate_subscripts(toks, 1) AS i
        FROM (SELECT doc_id, regexp_split_to_array(content, '[^\p{L}\p{N}]+') AS toks,
                     regexp_extract_all(content, '[^\p{L}\p{N}]+') AS seps FROM hd))
),
tok2 AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r, st AS a, st + length(t) AS b,
         lower(t) AS term
  FROM tk WHERE t <> '' AND strlen(t) < 40
),
nxt AS (
  SELECT doc_id, r, nr FROM (
    SELECT doc_id, r, kind,
           min(CASE WHEN kind = 0 THEN r END) OVER (
             PARTITION BY doc_id ORDER BY key, kind ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nr
    FROM (SELECT doc_id, r, b AS key, 0 AS kind FROM tok2
          UNION ALL SELECT doc_id, r, a + 150, 1 FROM tok2))
  WHERE kind = 1 AND nr IS NOT NULL
),
chain(doc_id, r) AS (
  SELECT doc_id, min(r) FROM tok2 WHERE b > 150 GROUP BY doc_id
  UNION ALL
  SELECT n.doc_id, n.nr FROM chain c JOIN nxt n ON n.doc_id = c.doc_id AND n.r = c.r
),
fstarts AS (
  SELECT doc_id, 0 AS fr, 0 AS fa FROM hd
  UNION ALL SELECT c.doc_id, c.r, t.a FROM chain c JOIN tok2 t ON t.doc_id = c.doc_id AND t.r = c.r
),
tf AS (
  SELECT doc_id, r, a, b, term, fa FROM (
    SELECT doc_id, r, a, b, term, kind,
           max(fa) OVER (PARTITION BY doc_id ORDER BY key, kind ROWS UNBOUNDED PRECEDING) AS fa
    FROM (SELECT doc_id, fr AS key, 0 AS kind, NULL AS r, NULL AS a, NULL AS b, NULL AS term, fa FROM fstarts
          UNION ALL SELECT doc_id, r, 1, r, a, b, term, NULL FROM tok2))
  WHERE kind = 1
),
fstop AS (SELECT doc_id, fa, max(b) AS stop FROM tf GROUP BY doc_id, fa),
ht AS (
  SELECT r.query_id, r.doc_id, t.fa, t.a, t.b, w.w
  FROM ranked r JOIN tf t ON t.doc_id = r.doc_id JOIN qw w ON w.query_id = r.query_id AND w.term = t.term
),
fscore AS (SELECT query_id, doc_id, fa, round(sum(w), 9) AS sc FROM ht GROUP BY query_id, doc_id, fa),
best AS (
  SELECT query_id, doc_id, fa FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY sc DESC, fa) AS rn FROM fscore)
  WHERE rn = 1
),
pieces AS (
  SELECT h.query_id, h.doc_id, h.fa, h.a, h.b,
         coalesce(lag(h.b) OVER (PARTITION BY h.query_id, h.doc_id ORDER BY h.a), h.fa) AS pe
  FROM ht h JOIN best x ON x.query_id = h.query_id AND x.doc_id = h.doc_id AND x.fa = h.fa
),
snip AS (
  SELECT p.query_id, p.doc_id,
         string_agg(substr(d.content, p.pe + 1, p.a - p.pe) || '<<' || substr(d.content, p.a + 1, p.b - p.a) || '>>',
                    '' ORDER BY p.a)
         || substr(any_value(d.content), max(p.b) + 1, any_value(s.stop) - max(p.b)) AS snippet
  FROM pieces p JOIN hd d ON d.doc_id = p.doc_id JOIN fstop s ON s.doc_id = p.doc_id AND s.fa = p.fa
  GROUP BY p.query_id, p.doc_id
),
whole AS (
  SELECT r.query_id, r.rank, r.doc_id AS id, d.entity, d.topic, d.name, d.title, d.tags,
         CASE WHEN s.snippet IS NULL THEN CAST([] AS VARCHAR[]) ELSE [s.snippet] END AS snippets, r.score
  FROM ranked r JOIN docs d ON d.id = r.doc_id LEFT JOIN snip s ON s.query_id = r.query_id AND s.doc_id = r.doc_id
)"""

ORACLE["search_snippets"] = SNIPPETS + """
SELECT query_id, rank, id AS doc_id, array_to_string(snippets, chr(10)) AS snippet FROM whole"""

ORACLE["search_hits_full"] = SNIPPETS + """
SELECT query_id, rank, id, entity, topic, name, title, array_to_string(tags, ',') AS tags,
       array_to_string(snippets, chr(10)) AS snippets, CAST(len(snippets) AS BIGINT) AS n_snippets, score FROM whole"""

ORACLE["hits_json"] = SNIPPETS + """
SELECT query_id, rank, CAST(json_object('id', id, 'entity', entity, 'topic', topic, 'name', name, 'title', title,
       'tags', tags, 'snippets', snippets, 'score', score) AS VARCHAR) AS json FROM whole"""

ORACLE["hits_text"] = SNIPPETS + """
SELECT query_id, rank, array_to_string(['[' || printf('%.2f', score) || '] ' || name || '  (' || concat_ws('/', entity, topic) || ')']
       || list_transform(snippets, lambda x: '       ' || x), chr(10)) AS text FROM whole"""

# ------------------------------------------------------------------ index tables

ORACLE["tokenize_docs"] = with_ctes(DOCS, FIELD_TEXTS) + """
SELECT doc_id, field, CAST(pos AS BIGINT) AS pos, term FROM tok"""

ORACLE["postings"] = with_ctes(DOCS, FIELD_TEXTS) + """
SELECT p.field, p.term, p.doc_id, CAST(p.tf AS BIGINT) AS tf, CAST(d.dl AS BIGINT) AS dl,
       array_to_string(p.positions, ',') AS positions
FROM postings p JOIN dls d ON d.doc_id = p.doc_id AND d.field = p.field"""

ORACLE["term_stats"] = with_ctes(DOCS, FIELD_TEXTS) + """
SELECT field, term, count(*) AS df FROM postings GROUP BY field, term"""

ORACLE["corpus_stats"] = with_ctes(DOCS, FIELD_TEXTS) + """
SELECT field, n_docs, round(avgdl, 6) AS avgdl FROM corpus"""


def _on_final(part: str) -> str:
    return part.replace("FROM docs", "FROM final")


for _key, _ops in [("index_upsert", "true"), ("index_remove", "op = 'delete'"), ("index_rebuild", "true")]:
    ORACLE[_key] = apply_sql(_ops, "," + _on_final(FIELD_TEXTS) + """
SELECT p.field, p.term, p.doc_id, CAST(p.tf AS BIGINT) AS tf, CAST(d.dl AS BIGINT) AS dl,
       array_to_string(p.positions, ',') AS positions
FROM postings p JOIN dls d ON d.doc_id = p.doc_id AND d.field = p.field""")
    ORACLE[f"{_key}_terms"] = apply_sql(_ops, "," + _on_final(FIELD_TEXTS) + """
SELECT field, term, count(*) AS df FROM postings GROUP BY field, term""")
    ORACLE[f"{_key}_corpus"] = apply_sql(_ops, "," + _on_final(FIELD_TEXTS) + """
SELECT field, n_docs, round(avgdl, 6) AS avgdl FROM corpus""")

ORACLE["docs_upsert"] = apply_sql("true", """,
changed AS (
  SELECT f.* FROM final f LEFT JOIN docs d ON d.id = f.id
  WHERE d.id IS NULL OR f.updated_at <> d.created_at
)
SELECT id, name, md5(content) AS content_md5, title FROM docs WHERE id NOT IN (SELECT id FROM changed)
UNION ALL SELECT id, name, md5(content), title FROM changed""")

# ------------------------------------------------------------------ entities and fuzzy names

SIM = "round(jaro_winkler_similarity({a}, {b}), 12) > 0.85"

CREATE_REQ = """
req AS (
  SELECT p_partkey AS seq,
         CASE WHEN p_partkey % 11 = 0 THEN p_name
              WHEN p_partkey % 3 = 0 THEN 'nation-' || CAST(p_size AS VARCHAR)
              ELSE lower(replace(p_name, ' ', '-')) END AS name,
         CASE WHEN p_partkey % 7 = 0 THEN 'team' WHEN p_partkey % 2 = 0 THEN 'knowledge'
              ELSE 'project' END AS scope,
         p_type AS description, [lower(p_brand)] AS tags,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(p_partkey) AS ts
  FROM part
)"""

ORACLE["similar_entities"] = with_ctes(ENTITIES, CREATE_REQ) + f"""
SELECT r.name, string_agg(e.name, ',' ORDER BY e.name) AS suggestions
FROM (SELECT DISTINCT name FROM req) r, ents e
WHERE {SIM.format(a='r.name', b='e.name')}
GROUP BY r.name"""

CREATE_WALK = "WITH RECURSIVE " + ",".join([ENTITIES, CREATE_REQ, f"""
req2 AS (
  SELECT r.*, row_number() OVER (ORDER BY r.seq) AS rn,
         r.scope IN ('knowledge', 'project') AS scope_ok,
         coalesce(regexp_full_match(r.name, {SEG}), false) AS name_ok,
         coalesce((SELECT list(e.name) FROM ents e WHERE {SIM.format(a='e.name', b='r.name')}),
                  CAST([] AS VARCHAR[])) AS sim_existing
  FROM req r
),
walk(rn, accepted, seq, status, detail) AS (
  SELECT 0, CAST([] AS VARCHAR[]), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
  UNION ALL
  SELECT r.rn,
         CASE WHEN r.scope_ok AND r.name_ok AND len(r.sim_existing) = 0
                   AND len(list_filter(w.accepted, lambda x: {SIM.format(a='x', b='r.name')})) = 0
              THEN list_append(w.accepted, r.name) ELSE w.accepted END,
         r.seq,
         CASE WHEN NOT r.scope_ok THEN 'invalid_scope'
              WHEN NOT r.name_ok THEN 'invalid_path'
              WHEN len(r.sim_existing) > 0
                   OR len(list_filter(w.accepted, lambda x: {SIM.format(a='x', b='r.name')})) > 0
              THEN 'similar_entity_exists'
              ELSE 'accepted' END,
         CASE WHEN NOT r.scope_ok THEN r.scope
              WHEN NOT r.name_ok THEN r.name
              ELSE array_to_string(list_sort(list_concat(r.sim_existing,
                     list_filter(w.accepted, lambda x: {SIM.format(a='x', b='r.name')}))), ',') END
  FROM walk w JOIN req2 r ON r.rn = w.rn + 1
)"""])

ORACLE["create_entities"] = CREATE_WALK + f"""
SELECT id, name, scope, description, array_to_string(tags, ',') AS tags,
       regexp_replace(strftime(created_at, {RFC}), '([.]000000|000)Z$', 'Z') AS created_at FROM ents
UNION ALL
SELECT 'ent-' || r.name, r.name, r.scope, r.description, array_to_string(r.tags, ','),
       regexp_replace(strftime(r.ts, {RFC}), '([.]000000|000)Z$', 'Z')
FROM walk w JOIN req2 r ON r.seq = w.seq WHERE w.status = 'accepted'"""

ORACLE["create_entities_rejects"] = CREATE_WALK + """
SELECT seq, status AS reason, detail FROM walk WHERE status IS NOT NULL AND status <> 'accepted'"""

PATCHES = """
patches AS (
  SELECT event_id AS seq, 'ent-src' || CAST(user_id % 25 AS VARCHAR) AS id,
         CASE WHEN value > 40 THEN 'project' WHEN value > 35 THEN 'Knowledge' END AS scope,
         'Purchase ' || CAST(event_id AS VARCHAR) AS description,
         CASE WHEN value > 45 THEN ['vip'] END AS tags, ts
  FROM events WHERE event_type = 'purchase'
),
good AS (
  SELECT * FROM patches WHERE (scope IS NULL OR scope IN ('knowledge', 'project'))
    AND id IN (SELECT id FROM ents)
),
agg AS (
  SELECT id, arg_max(scope, seq) FILTER (WHERE scope IS NOT NULL) AS p_scope,
         arg_max(description, seq) FILTER (WHERE description IS NOT NULL) AS p_desc,
         arg_max(tags, seq) FILTER (WHERE tags IS NOT NULL) AS p_tags, max(ts) AS p_ts
  FROM good GROUP BY id
)"""

ORACLE["update_entities"] = with_ctes(ENTITIES, PATCHES) + f"""
SELECT e.id, e.name, coalesce(a.p_scope, e.scope) AS scope, coalesce(a.p_desc, e.description) AS description,
       array_to_string(coalesce(a.p_tags, e.tags), ',') AS tags,
       regexp_replace(strftime(coalesce(a.p_ts, e.created_at), {RFC}), '([.]000000|000)Z$', 'Z') AS updated_at
FROM ents e LEFT JOIN agg a ON a.id = e.id"""

ORACLE["update_entities_rejects"] = with_ctes(ENTITIES, PATCHES) + """
SELECT seq, 'invalid_scope' AS reason, scope AS detail FROM patches
WHERE scope IS NOT NULL AND scope NOT IN ('knowledge', 'project')
UNION ALL
SELECT seq, 'not_found', id FROM patches
WHERE (scope IS NULL OR scope IN ('knowledge', 'project')) AND id NOT IN (SELECT id FROM ents)"""

EDELS = """
edels AS (
  SELECT event_id AS seq,
         CASE WHEN user_id % 5 = 0 THEN 'ent-src' || CAST(user_id % 40 AS VARCHAR)
              ELSE 'ent-nation-' || CAST(user_id % 40 AS VARCHAR) END AS id
  FROM events WHERE event_type = 'error'
),
gone AS (SELECT DISTINCT id FROM edels WHERE id IN (SELECT id FROM ents))"""

ORACLE["delete_entities"] = with_ctes(ENTITIES, EDELS) + """
SELECT id, name FROM ents WHERE id NOT IN (SELECT id FROM gone)"""

ORACLE["delete_entities_docs"] = with_ctes(DOCS, ENTITIES, EDELS, FIELD_TEXTS) + """,
np AS (
  SELECT doc_id AS id, count(*) AS n_postings FROM (
    SELECT doc_id FROM postings UNION ALL SELECT doc_id FROM rawpost) GROUP BY doc_id
)
SELECT d.id, d.entity, np.n_postings FROM docs d LEFT JOIN np ON np.id = d.id
WHERE d.entity_id NOT IN (SELECT id FROM gone)"""

ORACLE["delete_entities_rejects"] = with_ctes(ENTITIES, EDELS) + """
SELECT seq, 'not_found' AS reason, id AS detail FROM edels
WHERE id NOT IN (SELECT id FROM gone)
   OR seq > (SELECT min(x.seq) FROM edels x WHERE x.id = edels.id)"""

# ------------------------------------------------------------------ vault

def _yq(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


def _tags_yaml(x: str) -> str:
    return (f"CASE WHEN len({x}) > 0 THEN 'tags:' || chr(10) || "
            f"array_to_string(list_transform({x}, lambda t: '- ' || {_yq('t')} || chr(10)), '') ELSE '' END")


def _file_text(header: str, body: str) -> str:
    return (f"CASE WHEN coalesce({body}, '') = '' THEN '---' || chr(10) || {header} || '---' || chr(10) "
            f"ELSE '---' || chr(10) || {header} || '---' || chr(10) || chr(10) || {body} END")


DOC_HEADER = (f"'id: ' || {_yq('id')} || chr(10) || 'title: ' || {_yq('title')} || chr(10) || "
              f"{_tags_yaml('tags')} || 'created_at: ' || regexp_replace(strftime(created_at, {RFC}), '([.]000000|000)Z$', 'Z') || chr(10) || "
              f"'updated_at: ' || regexp_replace(strftime(created_at, {RFC}), '([.]000000|000)Z$', 'Z') || chr(10)")
ENT_HEADER = (f"'id: ' || {_yq('id')} || chr(10) || 'scope: ' || scope || chr(10) || "
              f"{_tags_yaml('tags')} || 'created_at: ' || regexp_replace(strftime(created_at, {RFC}), '([.]000000|000)Z$', 'Z') || chr(10) || "
              f"'updated_at: ' || regexp_replace(strftime(created_at, {RFC}), '([.]000000|000)Z$', 'Z') || chr(10)")

ORACLE["render_vault"] = with_ctes(DOCS, ENTITIES, f"""
files AS (
  SELECT 'entities/' || name || '/_entity.md' AS path, {_file_text(ENT_HEADER, 'description')} AS text FROM ents
  UNION ALL
  SELECT 'entities/' || concat_ws('/', entity, topic, name) || '.md', {_file_text(DOC_HEADER, 'content')} FROM docs
)""") + """
SELECT path, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars FROM files"""

DOC_ROWS = f"""
SELECT id, entity, topic, name, title, array_to_string(tags, ',') AS tags,
       regexp_replace(strftime(created_at, {RFC}), '([.]000000|000)Z$', 'Z') AS created_at, regexp_replace(strftime(created_at, {RFC}), '([.]000000|000)Z$', 'Z') AS updated_at,
       md5(content) AS content_md5 FROM docs"""

ORACLE["parse_frontmatter"] = with_ctes(DOCS) + DOC_ROWS
ORACLE["scan_vault_documents"] = with_ctes(DOCS) + DOC_ROWS
ORACLE["scan_vault_entities"] = with_ctes(ENTITIES) + f"""
SELECT id, name, scope, description, array_to_string(tags, ',') AS tags,
       regexp_replace(strftime(created_at, {RFC}), '([.]000000|000)Z$', 'Z') AS created_at FROM ents"""
ORACLE["rebuild_metadata"] = with_ctes(DOCS, ENTITIES) + """
SELECT 'entities' AS "table", count(*) AS n FROM ents
UNION ALL SELECT 'documents', count(*) FROM docs"""
ORACLE["vault_orphans"] = apply_sql("true", """
SELECT 'entities/' || concat_ws('/', entity, topic, name) || '.md' AS path, 'missing_file' AS kind
FROM final WHERE id NOT IN (SELECT id FROM docs)
UNION ALL
SELECT 'entities/' || concat_ws('/', entity, topic, name) || '.md', 'untracked_file'
FROM docs WHERE id NOT IN (SELECT id FROM final)""")

# ------------------------------------------------------------------ audits

LINKED = r"""
ndoc AS (SELECT count(*) AS n FROM documents),
linked AS (
  SELECT d.id, d.entity, d.name,
         d.content || chr(10) || 'See [[doc-' || CAST((d.doc_num * 7 + 3) % c.n AS VARCHAR) || ']] and [[doc-'
           || CAST((d.doc_num * 13 + 5) % c.n AS VARCHAR) || '|see also]] and [[doc-'
           || CAST(d.doc_num + c.n AS VARCHAR) || '#intro]].' AS content
  FROM docs d, ndoc c
),
edges AS (
  SELECT id AS src_id, entity AS src_entity, trim(unnest(regexp_extract_all(content, '\[\[([^\]|#]+)', 1))) AS dst_name
  FROM linked
)"""

ORACLE["wikilink_edges"] = with_ctes(DOCS, LINKED) + "SELECT src_id, src_entity, dst_name FROM edges"

ORACLE["backlinks"] = with_ctes(DOCS, LINKED) + """
SELECT d.id AS dst_id, e.dst_name, count(*) AS backlinks,
       count(DISTINCT e.src_entity) FILTER (WHERE e.src_entity <> d.entity) AS foreign_entities
FROM edges e JOIN docs d ON d.name = e.dst_name
GROUP BY d.id, e.dst_name, d.entity"""

ORACLE["broken_links"] = with_ctes(DOCS, LINKED) + """
SELECT src_id, dst_name FROM edges WHERE dst_name NOT IN (SELECT name FROM docs)"""

ORACLE["docs_by_tag"] = with_ctes(DOCS) + """
SELECT tag, count(DISTINCT id) AS n_docs, count(DISTINCT entity) AS n_entities
FROM (SELECT id, entity, unnest(tags) AS tag FROM docs) GROUP BY tag"""

ORACLE["docs_tagged_toxic"] = with_ctes(DOCS) + """
SELECT id, entity, topic FROM docs WHERE list_contains(tags, 'toxic')"""

ORACLE["topic_audit"] = with_ctes(DOCS, ENTITIES, COUNTS) + """
SELECT 'entity_without_topics' AS finding, entity, CAST(NULL AS VARCHAR) AS topic, CAST(sum(document_count) AS BIGINT) AS n
FROM counts GROUP BY entity HAVING sum(document_count) > 7 AND count(topic) = 0
UNION ALL
SELECT 'thin_topic', entity, topic, document_count FROM counts WHERE topic IS NOT NULL AND document_count < 3"""

ORACLE["tag_path_audit"] = with_ctes(DOCS) + """
SELECT id, entity, topic, array_to_string(rep, ',') AS repeated FROM (
  SELECT d.id, d.entity, d.topic,
         list_filter(list_append(d.tags, s.lang), lambda t: t = d.entity OR t = coalesce(d.topic, '')) AS rep
  FROM docs d JOIN documents s ON s.doc_id = d.doc_num)
WHERE len(rep) > 0"""

# ------------------------------------------------------------------ streams

ORACLE["stream_apply_changes"] = ORACLE["apply_changes"]
ORACLE["stream_index"] = apply_sql("true", """,
changed AS (
  SELECT f.* FROM final f LEFT JOIN docs d ON d.id = f.id
  WHERE d.id IS NULL OR f.updated_at <> d.created_at
),
upserted AS (
  SELECT id, title, content, tags FROM docs WHERE id NOT IN (SELECT id FROM changed)
  UNION ALL SELECT id, title, content, tags FROM changed
),""" + FIELD_TEXTS.replace("FROM docs", "FROM upserted") + """
SELECT field, term, count(*) AS df FROM postings GROUP BY field, term""")


# ------------------------------------------------------------------ JSON and second corpus

ORACLE["entry_json"] = with_ctes(DOCS) + f"""
SELECT id, CAST(json_object('id', id, 'entity', entity, 'topic', topic, 'name', name, 'title', title,
       'content', content, 'tags', tags, 'created_at', regexp_replace(strftime(created_at, {RFC}), '([.]000000|000)Z$', 'Z'),
       'updated_at', regexp_replace(strftime(created_at, {RFC}), '([.]000000|000)Z$', 'Z')) AS VARCHAR) AS json,
       CAST(to_json(tags) AS VARCHAR) AS tags_json
FROM docs"""

ORACLE["tags_json_round_trip"] = with_ctes(DOCS) + """
SELECT id, array_to_string(tags, ',') AS tags, true AS same FROM docs"""

CONV_DOCS = r"""
docs AS (
  SELECT 'C' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id,
         role AS entity, CAST(NULL AS VARCHAR) AS topic,
         'conv-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS name,
         split_part(text, chr(10), 1) AS title,
         coalesce(text, '') AS content, CAST([] AS VARCHAR[]) AS tags
  FROM conversations
)"""

ORACLE["search_conversations"] = (
    with_ctes(CONV_DOCS, FIELD_TEXTS, QTERMS, TERM_SCORES,
              "agg AS (SELECT query_id, doc_id, sum(score) AS score FROM scored GROUP BY 1, 2)")
    + topk_sql("agg"))

ORACLE["entities_json"] = with_ctes(ENTITIES) + f"""
SELECT name, CAST(json_object('id', id, 'name', name, 'scope', scope, 'description', description,
       'tags', tags, 'created_at', regexp_replace(strftime(created_at, {RFC}), '([.]000000|000)Z$', 'Z'), 'updated_at', regexp_replace(strftime(created_at, {RFC}), '([.]000000|000)Z$', 'Z')) AS VARCHAR) AS json
FROM ents"""
