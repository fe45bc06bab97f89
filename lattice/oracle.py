"""DuckDB SQL for the graph engine's queries."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_ENTITIES = """
SELECT 1000000000000 + r_regionkey AS id, r_name AS canonical_name, 'region' AS entity_type, '{}' AS attributes FROM region
UNION ALL SELECT 2000000000000 + n_nationkey, n_name, 'nation', '{}' FROM nation
UNION ALL SELECT 3000000000000 + c_custkey, c_name, 'customer', '{"segment":"' || c_mktsegment || '"}' FROM customer
UNION ALL SELECT 4000000000000 + s_suppkey, s_name, 'supplier', CASE WHEN s_acctbal > 0 THEN '{"in_credit":true}' ELSE '{}' END FROM supplier
UNION ALL SELECT 5000000000000 + p_partkey, p_name, 'part', '{"brand":"' || p_brand || '"' || CASE WHEN p_size > 25 THEN ',"size":' || p_size ELSE '' END || '}' FROM part
"""
_RELATIONS = """
SELECT 1000000000000000000 + n_nationkey::BIGINT * 1000000000 AS id, 2000000000000 + n_nationkey AS subject_id, 'located_in' AS predicate, 1000000000000 + n_regionkey AS object_id, NULL::BIGINT AS evidence_chunk_id, 1.0::DOUBLE AS confidence FROM nation
UNION ALL SELECT 2000000000000000000 + c_custkey * 1000000000, 3000000000000 + c_custkey, 'based_in', 2000000000000 + c_nationkey, NULL, 0.9 FROM customer
UNION ALL SELECT 3000000000000000000 + s_suppkey * 1000000000, 4000000000000 + s_suppkey, 'based_in', 2000000000000 + s_nationkey, NULL, 0.9 FROM supplier
UNION ALL SELECT 4000000000000000000 + l_suppkey * 1000000000 + l_partkey, 4000000000000 + l_suppkey, 'supplies', 5000000000000 + l_partkey, min(l_orderkey), 0.8 FROM lineitem GROUP BY l_suppkey, l_partkey
UNION ALL SELECT 5000000000000000000 + o_custkey * 1000000000 + l_partkey, 3000000000000 + o_custkey, 'ordered', 5000000000000 + l_partkey, min(l_orderkey), NULL FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey
"""
_MENTIONS = """
SELECT l_orderkey * 10 + l_linenumber AS id, 5000000000000 + l_partkey AS entity_id,
  CASE l_returnflag WHEN 'N' THEN p_name WHEN 'A' THEN upper(p_name) ELSE p_brand || ' ' || p_name END AS surface_form, l_orderkey AS chunk_id
FROM lineitem JOIN part ON l_partkey = p_partkey
"""
_WITH = f"WITH RECURSIVE e AS ({_ENTITIES}), r AS ({_RELATIONS}), m AS ({_MENTIONS}), named AS (SELECT r.*, s.canonical_name AS subject, s.entity_type AS subject_type, o.canonical_name AS object, o.entity_type AS object_type FROM r JOIN e s ON subject_id = s.id JOIN e o ON object_id = o.id)"


def _sql(name: str, text: str, ctes: str = "") -> None:
    ORACLE[name] = f"{_WITH}{', ' + ctes if ctes else ''} {text}"


_LISTED = "SELECT id, canonical_name AS name, entity_type AS type, attributes FROM e"
_sql("list_entities_by_type", f"{_LISTED} WHERE entity_type = 'supplier' ORDER BY name, id LIMIT 50")
_sql("list_entities_search", f"{_LISTED} WHERE lower(canonical_name) LIKE '%an%'")
_NAMED = "SELECT id, subject, subject_type, predicate, object, object_type, confidence, '{}' AS attributes FROM named"
_sql("list_relations", f"{_NAMED} ORDER BY id LIMIT 50")
_sql("list_relations_filtered", f"{_NAMED} WHERE predicate = 'based_in' AND object = (SELECT arg_min(n_name, n_nationkey) FROM nation)")
_sql(
    "entity_record",
    """SELECT 'entity' AS part, id, canonical_name AS a, entity_type AS b, attributes AS c FROM it
UNION ALL SELECT 'mention', m.id, surface_form, substr('order ' || o_orderkey || ' ' || o_orderstatus || ' ' || o_orderpriority, 1, 200), 'customers/' || c_name || '.md'
  FROM m JOIN it ON entity_id = it.id JOIN orders ON chunk_id = o_orderkey JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'outgoing', named.id, predicate, object, object_type FROM named JOIN it ON subject_id = it.id
UNION ALL SELECT 'incoming', named.id, predicate, subject, subject_type FROM named JOIN it ON object_id = it.id""",
    "it AS (SELECT * FROM e WHERE canonical_name = (SELECT arg_min(p_name, p_partkey) FROM part) ORDER BY id LIMIT 1)",
)
_sql("stats_counts", "SELECT 'documents' AS metric, count(*) AS n FROM customer UNION ALL SELECT 'chunks', count(*) FROM orders UNION ALL SELECT 'entities', count(*) FROM e UNION ALL SELECT 'relations', count(*) FROM r")
_sql("entity_type_counts", "SELECT entity_type, count(*) AS n FROM e GROUP BY entity_type")
_sql("predicate_counts", "SELECT predicate, count(*) AS n FROM r GROUP BY predicate")
_sql("type_vocabulary_top50", "SELECT string_agg(v, ', ' ORDER BY n DESC, v) AS vocabulary FROM (SELECT entity_type AS v, count(*) AS n FROM e GROUP BY v ORDER BY n DESC, v LIMIT 50)")
_sql("predicate_vocabulary_top50", "SELECT string_agg(v, ', ' ORDER BY n DESC, v) AS vocabulary FROM (SELECT predicate AS v, count(*) AS n FROM r GROUP BY v ORDER BY n DESC, v LIMIT 50)")
_sql("predicate_type_pairs", "SELECT * FROM (SELECT predicate, subject_type, object_type, count(*) AS n FROM named GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY predicate ORDER BY n DESC, subject_type, object_type) <= 10")
_sql(
    "attribute_key_frequency",
    "SELECT entity_type, attribute, n, round(n / total, 2) AS frequency FROM k JOIN (SELECT entity_type, count(*) AS total FROM e GROUP BY entity_type) USING (entity_type) QUALIFY row_number() OVER (PARTITION BY entity_type ORDER BY n DESC, attribute) <= 20",
    "k AS (SELECT entity_type, attribute, count(*) AS n FROM (SELECT entity_type, unnest(json_keys(attributes)) AS attribute FROM e) GROUP BY ALL)",
)
_sql("most_frequent_surface", "SELECT * FROM (SELECT entity_id, surface_form, count(*) AS n FROM m GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, surface_form) = 1")
_sql(
    "relation_dedupe",
    "SELECT min(id) AS id, subject_id, predicate, object_id, NULL::BIGINT AS evidence_chunk_id, arg_min(coalesce(confidence, -1), id) AS confidence FROM p GROUP BY subject_id, predicate, object_id",
    "p AS (SELECT r.id, 2000000000000 + c_nationkey AS subject_id, predicate, object_id, confidence FROM r JOIN customer ON subject_id = 3000000000000 + c_custkey)",
)
ORACLE["relation_dedupe"] = ORACLE["relation_dedupe"].replace("arg_min(coalesce(confidence, -1), id) AS confidence", "nullif(arg_min(coalesce(confidence, -1), id), -1) AS confidence")
_sql("vocabulary_gap", "SELECT DISTINCT surface_form AS name FROM m EXCEPT SELECT canonical_name FROM e")

ORACLE["content_hashes"] = "SELECT doc_id, sha256(text) AS content_hash, strlen(text)::BIGINT AS size_bytes FROM documents"
ORACLE["chunk_fixed"] = """
WITH s AS (SELECT doc_id, text, unnest(list_filter(range(0, greatest(length(text), 1), 3800), lambda x: x = 0 OR x + 200 < length(text))) AS a FROM documents WHERE regexp_matches(text, '[^[:space:]]'))
SELECT doc_id, (a / 3800)::INT AS chunk_index, a::INT AS char_start, least(a + 4000, length(text))::INT AS char_end,
  ((least(a + 4000, length(text)) - a) // 4)::INT AS token_count, md5(substr(text, a::BIGINT + 1, 4000)) AS content_md5 FROM s
"""


def _greedy(source: str, pieces: str, gap: int) -> str:
    """The greedy merge as a recursion over pieces: one row per step of each document."""
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, text, {pieces} AS p FROM (SELECT doc_id, {source} AS text FROM documents) WHERE regexp_matches(text, '[^[:space:]]')),
f AS (SELECT doc_id, p, 1 AS i, 0 AS a, length(p[1]) AS b, length(p[1]) AS size, -1 AS done_a, -1 AS done_b, len(p) AS n FROM t
  UNION ALL
  SELECT doc_id, p, i + 1, CASE WHEN size + length(p[i + 1]) > 1000 THEN b + {gap} ELSE a END, b + {gap} + length(p[i + 1]),
    CASE WHEN size + length(p[i + 1]) > 1000 THEN length(p[i + 1]) ELSE size + length(p[i + 1]) END,
    CASE WHEN size + length(p[i + 1]) > 1000 THEN a ELSE -1 END, CASE WHEN size + length(p[i + 1]) > 1000 THEN b ELSE -1 END, n FROM f WHERE i < n),
c AS (SELECT doc_id, done_a AS a, done_b AS b, i - 1 AS pos FROM f WHERE done_a >= 0 UNION ALL SELECT doc_id, a, b, n FROM f WHERE i = n)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS chunk_index, a::INT AS char_start, b::INT AS char_end, ((b - a) // 4)::INT AS token_count,
  md5(substr(text, a + 1, b - a)) AS content_md5 FROM c JOIN t USING (doc_id)
"""


ORACLE["chunk_paragraph"] = _greedy("replace(text, chr(10), chr(10) || chr(10))", "regexp_split_to_array(text, '\\n\\s*\\n')", 2)
ORACLE["chunk_heading"] = _greedy(
    "replace(text, chr(10), chr(10) || '## ')",
    r"list_concat(CASE WHEN regexp_matches(text, '^#{1,6}\s') THEN [''] ELSE [] END, list_transform(string_split(text, chr(10) || '## '), lambda x, i: CASE WHEN i > 1 THEN '## ' ELSE '' END || x || CASE WHEN i < len(string_split(text, chr(10) || '## ')) THEN chr(10) ELSE '' END))",
    0,
)
ORACLE["incremental_classify"] = """
WITH scan AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS h FROM documents), state AS (SELECT doc_id AS id, doc_id::VARCHAR AS path, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE sha256(text) END AS k FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(scan.path, state.path) AS path, id, CASE WHEN h IS NULL THEN 'absent' WHEN id IS NULL THEN 'new' WHEN h = k THEN 'skipped' ELSE 'updated' END AS change FROM scan FULL JOIN state ON scan.path = state.path
"""
ORACLE["embedding_backlog"] = "SELECT doc_id AS id, length(text)::BIGINT AS n FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"
ORACLE["entity_upsert"] = """
WITH known AS (SELECT s_name AS canonical_name, s_acctbal > 0 AS credit FROM supplier),
found AS (SELECT event_id, 'Supplier#' || lpad((user_id % ((SELECT count(*) FROM supplier) + 20))::VARCHAR, 9, '0') AS canonical_name, event_type FROM events),
k AS (SELECT canonical_name, event_type, min(event_id) AS first, max(event_id) AS last FROM found GROUP BY ALL),
j AS (SELECT canonical_name, string_agg('"' || event_type || '": ' || last, ', ' ORDER BY first) AS inside FROM k GROUP BY canonical_name)
SELECT canonical_name, 'supplier' AS entity_type, CASE WHEN inside IS NULL THEN CASE WHEN credit THEN '{"in_credit":true}' ELSE '{}' END
    ELSE '{' || CASE WHEN credit THEN '"in_credit": true, ' ELSE '' END || inside || '}' END AS attributes,
  CASE WHEN credit IS NULL THEN 't1' ELSE 't0' END AS created_at, CASE WHEN inside IS NULL THEN 't0' ELSE 't1' END AS updated_at FROM known FULL JOIN j USING (canonical_name)
"""
_sql(
    "relation_resolve",
    "SELECT min(seq) AS seq, s.id AS subject_id, 'bought' AS predicate, o.id AS object_id, evidence AS evidence_chunk_id FROM f JOIN least s ON f.subject = s.n JOIN least o ON f.object = o.n GROUP BY s.id, o.id, evidence",
    "least AS (SELECT canonical_name AS n, min(id) AS id FROM e GROUP BY n), f AS (SELECT l_orderkey * 10 + l_linenumber AS seq, 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS subject, p_name AS object, l_orderkey AS evidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)",
)
_PAIRS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.x, b.x) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.35)"
ORACLE["cosine_pairs"] = f"WITH {_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs"
ORACLE["similarity_components"] = f"""WITH RECURSIVE {_PAIRS}, both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT a AS node, a AS root FROM both_ways UNION SELECT b, root FROM reach JOIN both_ways ON node = a) SELECT node, min(root) AS component FROM reach GROUP BY node"""
_sql(
    "merge_entities",
    "SELECT min(id) AS id, subject_id, predicate, object_id, evidence_chunk_id FROM p GROUP BY subject_id, predicate, object_id, evidence_chunk_id",
    "k AS (SELECT 3000000000000 + c_custkey AS old, 3000000000000 + min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS keep FROM customer), p AS (SELECT r.id, coalesce(keep, subject_id) AS subject_id, predicate, object_id, evidence_chunk_id FROM r LEFT JOIN k ON subject_id = old)",
)
ORACLE["semantic_search_topk"] = """WITH q AS (SELECT arg_min(embedding::DOUBLE[], vec_id) AS x FROM embeddings)
SELECT vec_id, round(list_distance(embedding::DOUBLE[], x), 6) AS distance FROM embeddings, q ORDER BY list_distance(embedding::DOUBLE[], x), vec_id LIMIT 10"""

_START, _END = "Customer#000000001", "Customer#000000002"
_AROUND = "around AS MATERIALIZED (SELECT DISTINCT subject AS node, object AS next FROM named UNION SELECT object, subject FROM named)"


def _hops(depth: int, only: str | None = None) -> str:
    """CTEs v0, v1, ...: all nodes within so many hops."""
    keep = f" JOIN types ON next = n AND t = '{only}'" if only else ""
    out = [_AROUND, f"v0 AS MATERIALIZED (SELECT DISTINCT canonical_name AS node FROM e WHERE canonical_name = '{_START}')"]
    out += ["types AS (SELECT canonical_name AS n, arg_max(entity_type, id) AS t FROM e GROUP BY n)"] if only else []
    return ", ".join([*out, *(f"v{k} AS MATERIALIZED (SELECT node FROM v{k - 1} UNION SELECT next FROM around JOIN v{k - 1} USING (node){keep})" for k in range(1, depth + 1))])


_NODES = "SELECT canonical_name AS name, arg_max(entity_type, id) AS type, max(id) AS id FROM e WHERE canonical_name IN (SELECT node FROM {v}) GROUP BY canonical_name"
_sql("neighbors_depth1", _NODES.format(v="v1"), _hops(1))
_sql("neighbors_typed", _NODES.format(v="v3"), _hops(3, "part"))
_sql("neighbors_depth2_edges", "SELECT subject, arg_max(predicate, id) AS predicate, object, max(id) AS id FROM named WHERE subject IN (SELECT node FROM v2) AND object IN (SELECT node FROM v2) GROUP BY subject, object", _hops(2))


def _path(depth: int) -> str:
    """Level by level with least parents, then back from the end."""
    levels = [_AROUND, f"l0 AS MATERIALIZED (SELECT '{_START}' AS node, NULL::VARCHAR AS parent, 0 AS d)"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM l{i}" for i in range(k))
        levels.append(f"l{k} AS MATERIALIZED (SELECT next AS node, min(node) AS parent, {k} AS d FROM around JOIN l{k - 1} USING (node) WHERE next NOT IN ({seen}) AND NOT EXISTS (SELECT 1 FROM l{k - 1} x WHERE x.node = '{_END}') GROUP BY next)")
    levels.append("every_level AS (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(depth + 1)) + ")")
    levels.append(f"back AS (SELECT node, parent, d FROM every_level WHERE node = '{_END}' UNION ALL SELECT x.node, x.parent, x.d FROM back JOIN every_level x ON x.node = back.parent AND x.d = back.d - 1)")
    return ", ".join(levels)


_sql(
    "shortest_path",
    """SELECT (d - 1)::INT AS step, n.subject, n.predicate, n.object FROM back JOIN named n ON (n.subject = parent AND n.object = node) OR (n.subject = node AND n.object = parent)
WHERE parent IS NOT NULL QUALIFY row_number() OVER (PARTITION BY d ORDER BY (n.subject = parent) DESC, n.id DESC) = 1""",
    _path(5),
)

_CYPHER_PROPS = """CASE entity_type WHEN 'customer' THEN ', segment: ''' || json_extract_string(attributes, '$.segment') || ''''
  WHEN 'part' THEN ', brand: ''' || json_extract_string(attributes, '$.brand') || '''' || coalesce(', size: ' || json_extract_string(attributes, '$.size'), '')
  WHEN 'supplier' THEN CASE WHEN attributes = '{}' THEN '' ELSE ', in_credit: true' END ELSE '' END"""
_sql(
    "export_cypher_lines",
    f"""SELECT 'entity' AS kind, id, 'CREATE (e' || id || ':' || entity_type || ' {{name: ''' || canonical_name || '''' || {_CYPHER_PROPS} || '}});' AS line FROM e
UNION ALL SELECT 'relation', id, 'CREATE (e' || subject_id || ')-[:' || upper(predicate) || CASE WHEN confidence IS NULL THEN '' ELSE ' {{confidence: ' || confidence || '}}' END || ']->(e' || object_id || ');' FROM named""".replace("{{", "{").replace("}}", "}"),
)
_sql(
    "export_jsonld_nodes",
    """SELECT id, '{"@id": "kg:entity/' || id || '", "name": "' || canonical_name || '", "type": "kg:' || entity_type || '", "kg:entityType": "' || entity_type || '"' ||
  CASE entity_type WHEN 'customer' THEN ', "kg:segment": "' || json_extract_string(attributes, '$.segment') || '"'
    WHEN 'part' THEN ', "kg:brand": "' || json_extract_string(attributes, '$.brand') || '"' || coalesce(', "kg:size": ' || json_extract_string(attributes, '$.size'), '')
    WHEN 'supplier' THEN CASE WHEN attributes = '{}' THEN '' ELSE ', "kg:in_credit": true' END ELSE '' END || '}' AS node FROM e""",
)
_sql(
    "export_jsonld_edges",
    """SELECT id, '{"@type": "kg:Relation", "kg:subject": "kg:entity/' || subject_id || '", "kg:predicate": "' || predicate || '", "kg:object": "kg:entity/' || object_id || '"' ||
  CASE WHEN confidence IS NULL THEN '' ELSE ', "kg:confidence": ' || confidence END || '}' AS edge FROM named""",
)
_sql("export_graphml_edges", "SELECT subject_id::VARCHAR AS source, object_id::VARCHAR AS target, arg_max(predicate, id) AS predicate, coalesce(arg_max(coalesce(confidence, -1), id)::VARCHAR, '') AS confidence FROM named GROUP BY subject_id, object_id")
ORACLE["export_graphml_edges"] = ORACLE["export_graphml_edges"].replace("coalesce(arg_max(coalesce(confidence, -1), id)::VARCHAR, '')", "coalesce(nullif(arg_max(coalesce(confidence, -1), id), -1)::VARCHAR, '')")

_sql(
    "merge_attributes",
    """SELECT id, canonical_name, entity_type, attributes FROM e WHERE entity_type <> 'part'
UNION ALL SELECT 5000000000000 + p_partkey, p_name, 'part', CASE WHEN n = 1 THEN '{"brand":"' || p_brand || '"' || CASE WHEN p_size > 25 THEN ',"size":' || p_size ELSE '' END || '}'
  ELSE '{"brand": "' || p_brand || '"' || coalesce(', "size": ' || last_size, '') || '}' END FROM b JOIN part ON p_partkey = least""",
    "b AS (SELECT min(p_partkey) AS least, count(*) AS n, arg_max(p_size, p_partkey) FILTER (p_size > 25) AS last_size FROM part GROUP BY p_brand)",
)
_sql(
    "merge_mentions",
    "SELECT m.id, 5000000000000 + least AS entity_id, surface_form, chunk_id FROM m JOIN part ON entity_id = 5000000000000 + p_partkey JOIN b USING (p_brand)",
    "b AS (SELECT p_brand, min(p_partkey) AS least FROM part GROUP BY p_brand)",
)
_sql(
    "search_chunks",
    """SELECT o_orderkey::BIGINT AS chunk_id, 'order ' || o_orderkey || ' ' || o_orderstatus || ' ' || o_orderpriority AS chunk_text, 'customers/' || c_name || '.md' AS document_path, round(distance, 6) AS distance,
  coalesce((SELECT string_agg(canonical_name || ':part', ',' ORDER BY canonical_name) FROM (SELECT DISTINCT canonical_name FROM m JOIN e ON entity_id = e.id WHERE chunk_id = o_orderkey)), '') AS entities
FROM hits JOIN orders ON vec_id = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    """q AS (SELECT arg_min(embedding::DOUBLE[], vec_id) AS x FROM embeddings), hits AS (SELECT vec_id, list_distance(embedding::DOUBLE[], x) AS distance FROM embeddings, q
  WHERE vec_id IN (SELECT o_orderkey FROM orders) ORDER BY distance, vec_id LIMIT 10)""",
)
ORACLE["stale_documents"] = "SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 4 <= 1"
_sql(
    "export_graphml_nodes",
    """SELECT id, 0 AS place, 'label' AS key, canonical_name AS value FROM e UNION ALL SELECT id, 1, 'entity_type', entity_type FROM e
UNION ALL SELECT id, (1 + i)::INT, json_keys(attributes)[i], json_extract_string(attributes, '$.' || json_keys(attributes)[i]) FROM (SELECT *, unnest(range(1, len(json_keys(attributes)) + 1)) AS i FROM e)""",
)
ORACLE["code_fences"] = r"SELECT doc_id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text_md5 FROM documents"
_sql("drop_chunks_mentions", "SELECT id, entity_id, chunk_id FROM m WHERE chunk_id % 7 <> 0")
_sql("drop_chunks_relations", "SELECT id, subject_id, predicate, object_id, CASE WHEN evidence_chunk_id % 7 <> 0 THEN evidence_chunk_id END AS evidence_chunk_id FROM r")
_sql(
    "relation_insert",
    """SELECT subject_id * 1000000 + object_id % 1000000 AS id, subject_id, predicate, object_id, evidence_chunk_id FROM r WHERE predicate = 'supplies' AND subject_id % 3 = 0
UNION ALL SELECT 1000000000000000000 + row_number() OVER (ORDER BY id) - 1, subject_id, predicate, object_id, evidence_chunk_id FROM r WHERE predicate = 'supplies' AND subject_id % 3 <> 0""",
)
ORACLE["latest_run"] = "SELECT o_orderkey::BIGINT AS id, o_orderstatus AS status FROM orders ORDER BY o_orderkey DESC LIMIT 1"
