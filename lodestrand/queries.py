"""Named queries over a data directory, one or more for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand import adapters, schemas
from lodestrand.functions import LANGUAGES, indent, language
from lodestrand.operators import lookups, registry, vectors
from lodestrand.plans.compiler import run_query
from lodestrand.sources import chunker, extract, files, filters
from lodestrand.storage import settled, shared_path
from lodestrand.store import GraphStore
from lodestrand.streaming import debounce, workqueue

N = "(SELECT greatest(1, count(*)) FROM documents)"
NODES = f"""
entities AS (
  SELECT r_regionkey::BIGINT + 1000000000 AS id, r_name AS name, 'REGION' AS entity_type, r_regionkey::BIGINT % {N} AS chunk_id FROM region
  UNION ALL SELECT n_nationkey::BIGINT + 2000000000, n_name, 'NATION', n_nationkey::BIGINT % {N} FROM nation
  UNION ALL SELECT c_custkey + 3000000000, c_name, 'CUSTOMER', c_custkey % {N} FROM customer
  UNION ALL SELECT s_suppkey + 4000000000, s_name, 'SUPPLIER', s_suppkey % {N} FROM supplier
  UNION ALL SELECT p_partkey + 5000000000, p_name, 'PART', p_partkey % {N} FROM part
  UNION ALL SELECT o_orderkey + 6000000000, 'ORDER' || o_orderkey, 'ORDER', o_orderkey % {N} FROM orders
), edges AS (
  SELECT n_nationkey::BIGINT + 2000000000 AS s, n_regionkey::BIGINT + 1000000000 AS t, 'within' AS r, n_nationkey::BIGINT % {N} AS chunk_id FROM nation
  UNION ALL SELECT c_custkey + 3000000000, c_nationkey::BIGINT + 2000000000, 'livesin', c_custkey % {N} FROM customer
  UNION ALL SELECT s_suppkey + 4000000000, s_nationkey::BIGINT + 2000000000, 'basedin', s_suppkey % {N} FROM supplier
  UNION ALL SELECT o_custkey + 3000000000, o_orderkey + 6000000000, 'places', o_custkey % {N} FROM orders
  UNION ALL SELECT DISTINCT l_orderkey + 6000000000, l_partkey + 5000000000, 'contains', l_orderkey % {N} FROM lineitem
  UNION ALL SELECT DISTINCT l_suppkey + 4000000000, l_partkey + 5000000000, 'supplies', l_suppkey % {N} FROM lineitem
  UNION ALL SELECT DISTINCT s_nationkey::BIGINT + 2000000000, c_nationkey::BIGINT + 2000000000, 'trades', s_nationkey::BIGINT % {N}
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
    WHERE l_quantity >= 49 AND o_totalprice > 480000
), files AS (
  SELECT doc_id AS id, '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, n_chars AS last_mod_time, sha256(text) AS content_hash,
         CASE doc_id % 4 WHEN 0 THEN 'indexed' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing' ELSE 'failed' END AS status,
         (doc_id % 3)::INT AS retry_count, 1700000000 + (doc_id * 7919) % 100003 AS queued
  FROM documents
), chunks AS (
  SELECT doc_id AS chunk_id, doc_id AS file_id, text AS content_snippet, 1 AS start_line, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS end_line FROM documents
), state AS (
  SELECT doc_id AS chunk_id, doc_id % 3 = 1 AS graph_extracted FROM documents WHERE doc_id % 3 <> 0
), vecs AS (
  SELECT vec_id AS chunk_id, vec_id % {N} AS file_id, embedding::DOUBLE[] AS e FROM embeddings
)"""

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        QUERIES[name or fn.__name__] = fn
        if sql is not None:
            ORACLES[name or fn.__name__] = sql
        return fn

    return add


def cypher(name: str, text: str, sql: str, extended: bool = False, scope: str | None = None, chains: bool = False) -> None:
    """A query of the graph language, and the SQL behind `WITH entities, edges, ...`."""

    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = adapters.conversations(spark, sf_dir) if chains else adapters.graph(spark, sf_dir)
        return run_query(source, text, extended, scope)

    QUERIES[name] = fn
    ORACLES[name] = sql if sql.lstrip().startswith("WITH") else f"WITH {NODES} {sql}"


def walks(first: str, step: str, most: int) -> str:
    """Walks of the graph by recursion: (a, b, depth), without repeats at a depth."""
    return f"""WITH RECURSIVE {NODES}, w(a, b, d) AS (
  SELECT g.s, g.t, 1 FROM edges g JOIN entities x ON g.s = x.id JOIN entities y ON g.t = y.id WHERE {first}
  UNION SELECT w.a, g.t, w.d + 1 FROM w JOIN edges g ON w.b = g.s WHERE w.d < {most} AND {step}
) """


PAIR = "FROM w JOIN entities x ON w.a = x.id JOIN entities y ON w.b = y.id"
ONE = "FROM edges g JOIN entities x ON g.s = x.id JOIN entities y ON g.t = y.id"
cypher("match_forward", "MATCH (c:CUSTOMER)-[:livesin]->(n:NATION) RETURN c.name, n.name", f"SELECT x.name AS c_name, y.name AS n_name {ONE} WHERE x.entity_type = 'CUSTOMER' AND g.r = 'livesin' AND y.entity_type = 'NATION'")
cypher("match_backward", "MATCH (r:REGION)<-[:within]-(n:NATION) RETURN r.name, n.name", f"SELECT y.name AS r_name, x.name AS n_name {ONE} WHERE x.entity_type = 'NATION' AND g.r = 'within' AND y.entity_type = 'REGION'")
cypher("match_untyped", "MATCH (s:SUPPLIER)-[]->(x) RETURN s.id, x.id, x.entity_type", f"SELECT x.id AS s_id, y.id AS x_id, y.entity_type AS x_entity_type {ONE} WHERE x.entity_type = 'SUPPLIER'")
cypher("match_wildcard", "MATCH ()-[:trades]->(b) RETURN b.name", f"SELECT y.name AS b_name {ONE} WHERE g.r = 'trades'")
cypher("match_props", "MATCH (s:SUPPLIER)-[:basedin]->(n) RETURN s.name, s.snippet, s.file, s.lines, n.file", f"""SELECT x.name AS s_name, c.content_snippet AS s_snippet, f.path AS s_file, c.start_line || '-' || c.end_line AS s_lines, f2.path AS n_file
  {ONE} LEFT JOIN chunks c ON x.chunk_id = c.chunk_id LEFT JOIN files f ON c.file_id = f.id LEFT JOIN chunks c2 ON y.chunk_id = c2.chunk_id LEFT JOIN files f2 ON c2.file_id = f2.id WHERE x.entity_type = 'SUPPLIER' AND g.r = 'basedin'""")
cypher("match_whole_var", "MATCH (a)-[:within]->(b) RETURN a", f"SELECT x.* {ONE} WHERE g.r = 'within'")
cypher("match_two_whole_vars", "MATCH (a)-[:within]->(b) RETURN a, b", f"SELECT x.id AS a_id, x.name AS a_name, x.entity_type AS a_entity_type, x.chunk_id AS a_chunk_id, y.id AS b_id, y.name AS b_name, y.entity_type AS b_entity_type, y.chunk_id AS b_chunk_id {ONE} WHERE g.r = 'within'")
cypher("match_same_var", "MATCH (a)-[:trades]->(a) RETURN a.name AS ignored", f"SELECT x.name AS a_name {ONE} WHERE g.r = 'trades'")
cypher("match_scoped", "MATCH (s:SUPPLIER)-[:supplies]->(p) RETURN s.name, p.name", f"SELECT x.name AS s_name, y.name AS p_name {ONE} LEFT JOIN files f ON x.chunk_id = f.id LEFT JOIN files f2 ON y.chunk_id = f2.id WHERE x.entity_type = 'SUPPLIER' AND g.r = 'supplies' AND (f.path LIKE '/src1/%' OR f2.path LIKE '/src1/%')", scope="/src1")
cypher("count_group", "MATCH (a)-[:livesin]->(b) RETURN b.name, COUNT(a) AS n GROUP BY b.name", f"SELECT y.name AS b_name, count(DISTINCT x.id) AS n {ONE} WHERE g.r = 'livesin' GROUP BY y.name")
cypher("count_top10", "MATCH (a)-[:contains]->(b) RETURN b.id, COUNT(a) AS n GROUP BY b.id ORDER BY n DESC, b_id LIMIT 10", f"SELECT y.id AS b_id, count(DISTINCT x.id) AS n {ONE} WHERE g.r = 'contains' GROUP BY y.id ORDER BY n DESC, b_id LIMIT 10")
cypher("count_global", "MATCH (a:CUSTOMER)-[]->(b) RETURN b.entity_type, COUNT(a) AS n", f"SELECT min(y.entity_type) AS b_entity_type, count(DISTINCT x.id) AS n {ONE} WHERE x.entity_type = 'CUSTOMER'")
cypher("count_empty", "MATCH (a:REGION)-[:places]->(b) RETURN b.name, COUNT(a) AS n", f"SELECT min(y.name) AS b_name, count(DISTINCT x.id) AS n {ONE} WHERE x.entity_type = 'REGION' AND g.r = 'places'")
cypher("count_bare_column", "MATCH (a)-[:basedin]->(b) RETURN b.name, a.name, COUNT(a) AS n GROUP BY b.name", f"SELECT y.name AS b_name, min(x.name) AS a_name, count(DISTINCT x.id) AS n {ONE} WHERE g.r = 'basedin' GROUP BY y.name")
cypher("order_multi", "MATCH (a)-[:places]->(b) RETURN a.name, b.id ORDER BY weight, a_name DESC, b_id ASC LIMIT 25", f"SELECT x.name AS a_name, y.id AS b_id {ONE} WHERE g.r = 'places' ORDER BY a_name DESC, b_id LIMIT 25")
cypher("limit_zero", "MATCH (a)-[:within]->(b) RETURN a.name LIMIT 0", f"SELECT x.name AS a_name {ONE} WHERE false")
cypher("hop_exact2", "MATCH (a)-[:trades*2]->(b) RETURN a.name, b.name", walks("g.r = 'trades'", "g.r = 'trades'", 2) + f"SELECT DISTINCT x.name AS a_name, y.name AS b_name {PAIR} WHERE d >= 2")
cypher("hop_1_3", "MATCH (c:SUPPLIER)-[*1..3]->(b) RETURN c.name, b.name", walks("x.entity_type = 'SUPPLIER'", "true", 3) + f"SELECT DISTINCT x.name AS c_name, y.name AS b_name {PAIR}")
cypher("hop_2_4_back", "MATCH (a)<-[:trades*2..4]-(b) RETURN a.name, b.name", walks("g.r = 'trades'", "g.r = 'trades'", 4) + f"SELECT DISTINCT y.name AS a_name, x.name AS b_name {PAIR} WHERE d >= 2")
cypher("hop_cycle10", "MATCH (a:NATION)-[:trades*1..10]->(b) RETURN a.id, b.id", walks("g.r = 'trades'", "g.r = 'trades'", 10) + f"SELECT DISTINCT x.id AS a_id, y.id AS b_id {PAIR}")
cypher("hop_label_quirk", "MATCH (a:CUSTOMER)-[*1..2]->(b:NATION) RETURN a.id, b.name", walks("x.entity_type = 'CUSTOMER' AND y.entity_type = 'NATION'", "true", 2) + f"SELECT DISTINCT x.id AS a_id, y.name AS b_name {PAIR}")
cypher("hop_zero", "MATCH (a)-[:within*0]->(b) RETURN a.name, b.name", f"SELECT x.name AS a_name, y.name AS b_name {ONE} WHERE g.r = 'within'")
cypher("hop_empty_range", "MATCH (a)-[:trades*3..2]->(b) RETURN a.name", f"SELECT x.name AS a_name {ONE} WHERE false")
TURNS = """WITH RECURSIVE entities AS (SELECT conv_id * 1000 + turn AS id, role AS name, upper(role) AS entity_type, conv_id AS chunk_id FROM conversations),
edges AS (SELECT conv_id * 1000 + turn - 1 AS s, conv_id * 1000 + turn AS t FROM conversations WHERE turn > 0), w(a, b, d) AS (
  SELECT g.s, g.t, 1 FROM edges g JOIN entities x ON g.s = x.id JOIN entities y ON g.t = y.id UNION SELECT w.a, g.t, w.d + 1 FROM w JOIN edges g ON w.b = g.s WHERE w.d < 5) """
cypher("hop_chains", "MATCH (a:USER)-[:follows*3..5]->(b) RETURN a.id, b.id, b.name", TURNS + f"SELECT DISTINCT x.id AS a_id, y.id AS b_id, y.name AS b_name {PAIR} WHERE d >= 3 AND x.entity_type = 'USER'", chains=True)
cypher("where_filter", "MATCH (a)-[:supplies]->(p:PART) WHERE (a.name =~ '.*1' AND NOT p.id < 5000000100) OR p.id = 5000000007 RETURN a.name AS who, p.id", f"SELECT x.name AS who, y.id AS p_id {ONE} WHERE g.r = 'supplies' AND y.entity_type = 'PART' AND ((regexp_full_match(x.name, '.*1') AND NOT y.id < 5000000100) OR y.id = 5000000007)", extended=True)
cypher("node_scan", "MATCH (n:REGION) RETURN n.id, n.name AS title ORDER BY title", "SELECT id AS n_id, name AS title FROM entities WHERE entity_type = 'REGION'", extended=True)
cypher("agg_sum_avg", "MATCH (a:SUPPLIER)-[:basedin]->(b) RETURN b.name, SUM(a.id) AS total, AVG(a.id) AS mean, MIN(a.name) AS least, MAX(a.name) AS most GROUP BY b.name", f"SELECT y.name AS b_name, sum(x.id)::BIGINT AS total, avg(x.id) AS mean, min(x.name) AS least, max(x.name) AS most {ONE} WHERE x.entity_type = 'SUPPLIER' AND g.r = 'basedin' GROUP BY y.name", extended=True)
cypher("undirected", "MATCH (a:NATION)-[:trades]-(b) RETURN a.name, b.name", f"SELECT x.name AS a_name, y.name AS b_name FROM (SELECT s, t FROM edges WHERE r = 'trades' UNION ALL SELECT t, s FROM edges WHERE r = 'trades' AND s <> t) g JOIN entities x ON g.s = x.id JOIN entities y ON g.t = y.id", extended=True)
cypher("hop_strict_counted", "MATCH (a:SUPPLIER)-[*1..2]->(b:REGION) RETURN b.name, COUNT(a) AS n GROUP BY b.name ORDER BY n DESC, b_name LIMIT 3", walks("x.entity_type = 'SUPPLIER'", "true", 2) + f"SELECT y.name AS b_name, count(DISTINCT x.id) AS n {PAIR} WHERE y.entity_type = 'REGION' GROUP BY y.name ORDER BY n DESC, b_name LIMIT 3", extended=True)
cypher("hop_unbounded", "MATCH (a)-[:trades*]->(b) RETURN a.id, b.id", walks("g.r = 'trades'", "g.r = 'trades'", 10) + f"SELECT DISTINCT x.id AS a_id, y.id AS b_id {PAIR}", extended=True)


# -- lookups and counts


@query(f"""WITH {NODES}, near AS (SELECT s AS of_id, t AS id FROM edges UNION SELECT t, s FROM edges)
SELECT DISTINCT near.of_id, e.* FROM near JOIN entities e USING (id) JOIN entities o ON near.of_id = o.id WHERE o.entity_type = 'NATION' AND near.of_id <> near.id""")
def related_entities(spark, sf_dir):
    g = adapters.graph(spark, sf_dir)
    return lookups.related_entities(g.entities, g.edges, g.entities.filter("entity_type = 'NATION'"))


@query(f"WITH {NODES} SELECT s AS source_entity_id, t AS target_entity_id, r AS relation_type, chunk_id FROM edges WHERE s = 2000000003 OR t = 2000000003")
def entity_edges(spark, sf_dir):
    return lookups.entity_edges(adapters.graph(spark, sf_dir).edges, 2_000_000_003).drop("weight")


@query(f"WITH {NODES} SELECT * FROM entities WHERE entity_type = 'SUPPLIER'")
def entities_by_type(spark, sf_dir):
    return lookups.entities_by_type(adapters.graph(spark, sf_dir).entities, "SUPPLIER")


@query(f"WITH {NODES} SELECT * FROM entities WHERE name = 'ORDER17'")
def entities_by_name(spark, sf_dir):
    return lookups.entities_by_name(adapters.graph(spark, sf_dir).entities, "ORDER17")


@query(f"WITH {NODES} SELECT c.*, f.path FROM chunks c JOIN files f ON c.file_id = f.id WHERE chunk_id IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def chunks_by_ids(spark, sf_dir):
    g = adapters.graph(spark, sf_dir)
    ids = adapters.load(spark, sf_dir, "embeddings").filter("label = 3").select(F.col("vec_id").alias("chunk_id"))
    return lookups.chunks_by_ids(g.chunks, g.files, ids)


@query(f"WITH {NODES} SELECT c.*, f.path FROM chunks c JOIN files f ON c.file_id = f.id")
def chunks_with_paths(spark, sf_dir):
    g = adapters.graph(spark, sf_dir)
    return lookups.chunks_with_paths(g.chunks, g.files)


@query(f"WITH {NODES} SELECT id, path, queued FROM files WHERE status = 'pending' ORDER BY queued, id LIMIT 50")
def pending_files(spark, sf_dir):
    rows = lookups.pending_files(adapters.graph(spark, sf_dir).files, 50)
    return rows.select("id", "path", F.unix_timestamp("queued_at").alias("queued"))


@query(f"WITH {NODES} SELECT * FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM state WHERE graph_extracted) ORDER BY chunk_id LIMIT 150")
def needs_extraction(spark, sf_dir):
    g = adapters.graph(spark, sf_dir)
    return lookups.needing_extraction(g.chunks, g.state, 150)


@query(f"WITH {NODES} SELECT id, path FROM files ORDER BY path LIMIT 100 OFFSET 20")
def list_files_page(spark, sf_dir):
    return lookups.list_files(adapters.graph(spark, sf_dir).files, 0, 20).select("id", "path")


@query(f"WITH {NODES} SELECT id, path, content_hash FROM files WHERE id = 42")
def file_by_id(spark, sf_dir):
    return lookups.file_by_id(adapters.graph(spark, sf_dir).files, 42).select("id", "path", "content_hash")


@query(f"WITH {NODES} SELECT status, count(*) AS n FROM files GROUP BY status")
def count_by_status(spark, sf_dir):
    return lookups.count_by_status(adapters.graph(spark, sf_dir).files)


@query(f"WITH {NODES} SELECT total, extracted, greatest(0, total - extracted) AS pending FROM (SELECT count(*) AS total FROM chunks), (SELECT count(*) AS extracted FROM state WHERE graph_extracted)")
def extraction_stats(spark, sf_dir):
    g = adapters.graph(spark, sf_dir)
    return lookups.extraction_stats(g.chunks, g.state)


@query(f"WITH {NODES} SELECT 'chunks' AS what, count(*) AS n FROM chunks UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'files', count(*) FROM files")
def count_tables(spark, sf_dir):
    g = adapters.graph(spark, sf_dir)
    counts = [lookups.count_rows(getattr(g, t)).select(F.lit(t).alias("what"), "n") for t in ("chunks", "edges", "entities", "files")]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("WITH t AS (SELECT conv_id, turn, role FROM conversations), e AS (SELECT conv_id * 1000 + turn AS id, role AS name, conv_id AS chunk_id FROM t), f AS (SELECT name, arg_min(id, id) AS first_id, count(DISTINCT chunk_id) AS n FROM e GROUP BY name) SELECT f.first_id, e.id FROM e JOIN f USING (name) WHERE f.n > 1 AND e.id <> f.first_id")
def symbol_link(spark, sf_dir):
    return lookups.symbol_links(adapters.conversations(spark, sf_dir).entities)


# -- changes: events are touches of files, in the order of their ids


def _changes(spark, sf_dir) -> DataFrame:
    """Events as changes: a path of which half are known, a time, a hash, an order."""
    n = max(1, adapters.load(spark, sf_dir, "documents").count())
    files = adapters.graph(spark, sf_dir).files.select(F.col("id").alias("_i"), F.col("path").alias("_p"))
    events = adapters.load(spark, sf_dir, "events")
    known = events.join(files, (F.pmod(F.col("user_id"), F.lit(n)) == F.col("_i")) & (F.col("user_id") % 2 == 0), "left")
    path = F.coalesce("_p", F.concat(F.lit("/new/"), F.col("user_id").cast("string")))
    return known.select(path.alias("path"), F.col("event_id").alias("last_mod_time"), F.sha2("props", 256).alias("content_hash"), F.col("event_id").alias("seq"))


CHANGES = f"""changes AS (
  SELECT coalesce(f.path, '/new/' || user_id) AS path, event_id AS last_mod_time, sha256(props) AS content_hash, event_id AS seq
  FROM events LEFT JOIN files f ON user_id % {N} = f.id AND user_id % 2 = 0
), last AS (
  SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1
), fresh AS (
  SELECT (SELECT max(id) FROM files) + row_number() OVER (ORDER BY path) AS id, * FROM last WHERE path NOT IN (SELECT path FROM files)
)"""


@query(f"""WITH {NODES}, {CHANGES} SELECT f.id, f.path, coalesce(l.last_mod_time, f.last_mod_time) AS last_mod_time, coalesce(l.content_hash, f.content_hash) AS content_hash, f.status, l.path IS NOT NULL AS touched FROM files f LEFT JOIN last l USING (path)
UNION ALL SELECT id, path, last_mod_time, content_hash, 'indexed', true FROM fresh""")
def upsert_files(spark, sf_dir):
    rows = registry.upsert_files(adapters.graph(spark, sf_dir).files, _changes(spark, sf_dir), F.timestamp_seconds(F.lit(1)))
    return rows.select("id", "path", "last_mod_time", "content_hash", "status", F.col("indexed_at").isNotNull().alias("touched"))


@query(f"""WITH {NODES}, {CHANGES} SELECT f.id, f.path, CASE WHEN l.path IS NULL THEN f.status ELSE 'pending' END AS status, CASE WHEN l.path IS NULL THEN f.retry_count ELSE 0 END AS retry_count, CASE WHEN l.path IS NULL THEN f.queued ELSE 5 END AS queued FROM files f LEFT JOIN last l USING (path)
UNION ALL SELECT id, path, 'pending', 0, 5 FROM fresh""")
def mark_pending(spark, sf_dir):
    rows = registry.mark_pending(adapters.graph(spark, sf_dir).files, _changes(spark, sf_dir), F.timestamp_seconds(F.lit(5)))
    return rows.select("id", "path", "status", "retry_count", F.unix_timestamp("queued_at").alias("queued"))


@query(f"WITH {NODES}, {CHANGES} SELECT l.path, l.last_mod_time, l.content_hash, f.id IS NULL OR f.last_mod_time <> l.last_mod_time OR f.content_hash <> l.content_hash AS changed FROM last l LEFT JOIN files f USING (path)")
def file_changed(spark, sf_dir):
    last = registry.last_of(_changes(spark, sf_dir), ["path"]).drop("seq")
    return registry.changed_files(adapters.graph(spark, sf_dir).files, last)


def _proposed(spark, sf_dir) -> DataFrame:
    """Events as entities: some are there already, most come more than once."""
    n = max(1, adapters.load(spark, sf_dir, "documents").count())
    events = adapters.load(spark, sf_dir, "events")
    nation = F.col("user_id") % 50
    old = adapters.load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_k"), F.col("n_name").alias("_n"))
    rows = events.join(F.broadcast(old), nation == F.col("_k"), "left")  # 25 nations
    return rows.select(F.coalesce("_n", F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("name"), F.when(F.col("_n").isNotNull(), "NATION").otherwise("USER").alias("entity_type"), F.pmod(nation, F.lit(n)).alias("chunk_id"))


@query(f"""WITH {NODES}, p AS (SELECT DISTINCT coalesce(n_name, 'u' || user_id) AS name, CASE WHEN n_name IS NULL THEN 'USER' ELSE 'NATION' END AS entity_type, (user_id % 50) % {N} AS chunk_id FROM events LEFT JOIN nation ON user_id % 50 = n_nationkey)
SELECT * FROM entities UNION ALL SELECT (SELECT max(id) FROM entities) + row_number() OVER (ORDER BY name, entity_type, chunk_id), p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.name = p.name AND e.entity_type = p.entity_type AND e.chunk_id = p.chunk_id)""")
def upsert_entities(spark, sf_dir):
    return registry.upsert_entities(adapters.graph(spark, sf_dir).entities, _proposed(spark, sf_dir))


@query(f"""WITH {NODES}, c AS (SELECT 2000000000 + user_id % 25 AS s, 1000000000 + user_id % 5 AS t, event_type AS r, (user_id % 25) % {N} AS chunk_id, event_id FROM events),
l AS (SELECT s, t, r, chunk_id FROM c QUALIFY row_number() OVER (PARTITION BY s, t, chunk_id ORDER BY event_id DESC) = 1)
SELECT s AS source_entity_id, t AS target_entity_id, r AS relation_type, chunk_id, 1.0::DOUBLE AS weight FROM (SELECT * FROM edges g WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.s = g.s AND l.t = g.t AND l.chunk_id = g.chunk_id) UNION ALL SELECT * FROM l)""")
def upsert_edges_lastwins(spark, sf_dir):
    g = adapters.graph(spark, sf_dir)
    n = max(1, adapters.load(spark, sf_dir, "documents").count())
    u = F.col("user_id")
    changes = adapters.load(spark, sf_dir, "events").select((u % 25 + 2_000_000_000).alias("source_entity_id"), (u % 5 + 1_000_000_000).alias("target_entity_id"), F.col("event_type").alias("relation_type"), F.pmod(u % 25, F.lit(n)).alias("chunk_id"), F.col("event_id").alias("seq"))
    return registry.upsert_edges(g.edges, changes)


@query(f"WITH {NODES}, d AS (SELECT DISTINCT user_id AS id FROM events) SELECT f.id, CASE WHEN d.id IS NULL THEN status ELSE 'indexed' END AS status, CASE WHEN d.id IS NULL THEN retry_count ELSE 0 END AS retry_count FROM files f LEFT JOIN d USING (id)")
def mark_indexed(spark, sf_dir):
    ids = adapters.load(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    return registry.mark_indexed(adapters.graph(spark, sf_dir).files, ids, F.timestamp_seconds(F.lit(9))).select("id", "status", "retry_count")


@query(f"WITH {NODES}, d AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'error') SELECT f.id, CASE WHEN d.id IS NULL THEN status WHEN retry_count + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status, (retry_count + CASE WHEN d.id IS NULL THEN 0 ELSE 1 END)::INT AS retry_count FROM files f LEFT JOIN d USING (id)")
def retry_or_fail(spark, sf_dir):
    failures = adapters.load(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("id"), F.lit("x").alias("message"))
    return registry.retry_or_fail(adapters.graph(spark, sf_dir).files, failures, F.timestamp_seconds(F.lit(9))).select("id", "status", "retry_count")


@query(f"WITH {NODES} SELECT id, CASE status WHEN 'processing' THEN 'pending' ELSE status END AS status FROM files")
def reset_stuck(spark, sf_dir):
    return registry.reset_stuck(adapters.graph(spark, sf_dir).files).select("id", "status")


@query(f"WITH {NODES}, d AS (SELECT DISTINCT user_id AS chunk_id FROM events) SELECT chunk_id, graph_extracted FROM state WHERE chunk_id NOT IN (SELECT chunk_id FROM d) UNION ALL SELECT chunk_id, true FROM d")
def mark_extracted(spark, sf_dir):
    ids = adapters.load(spark, sf_dir, "events").select(F.col("user_id").alias("chunk_id"))
    return registry.mark_extracted(adapters.graph(spark, sf_dir).state, ids, F.timestamp_seconds(F.lit(9))).select("chunk_id", "graph_extracted")


@query(f"WITH {NODES} SELECT 'chunks' AS what, count(*) AS n FROM chunks WHERE file_id NOT IN (SELECT id FROM files WHERE status = 'failed') UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'state', count(*) FROM state")
def delete_cascade_absent(spark, sf_dir):
    g = adapters.graph(spark, sf_dir)
    left = registry.delete_chunks(g.chunks, g.files.filter("status = 'failed'").select(F.col("id").alias("file_id")))
    counts = [lookups.count_rows(t).select(F.lit(n).alias("what"), "n") for n, t in (("chunks", left), ("entities", g.entities), ("edges", g.edges), ("state", g.state))]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query(f"WITH {NODES} SELECT e.* FROM entities e WHERE chunk_id NOT IN (SELECT id FROM files WHERE status = 'failed')")
def delete_with_cascade(spark, sf_dir):
    g = adapters.graph(spark, sf_dir)
    left = registry.delete_chunks(g.chunks, g.files.filter("status = 'failed'").select(F.col("id").alias("file_id")))
    return registry.cascade(g.entities, left)


# -- vectors


def _query_vector(spark, sf_dir) -> list[float]:
    """The vector that is searched for: that of the least id."""
    return adapters.load(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


Q = "(SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)"
D = f"list_cosine_distance(e, {Q})"


@query(f"WITH {NODES}, k AS (SELECT *, {D} AS d FROM vecs ORDER BY d, chunk_id LIMIT 10) SELECT k.chunk_id, f.path, round(d, 6) AS distance FROM k JOIN files f ON k.file_id = f.id")
def knn10(spark, sf_dir):
    g = adapters.graph(spark, sf_dir)
    return vectors.search(g.vectors, g.files, _query_vector(spark, sf_dir)).select("chunk_id", "path", F.round("distance", 6).alias("distance"))


@query(f"WITH {NODES}, k AS (SELECT *, {D} AS d FROM vecs ORDER BY d, chunk_id LIMIT 40) SELECT k.chunk_id, f.path, round(d, 6) AS distance FROM k JOIN files f ON k.file_id = f.id WHERE f.path LIKE '/src3/%'")
def knn_postfilter(spark, sf_dir):
    g = adapters.graph(spark, sf_dir)
    return vectors.search(g.vectors, g.files, _query_vector(spark, sf_dir), 40, "/src3").select("chunk_id", "path", F.round("distance", 6).alias("distance"))


@query(f"WITH {NODES} SELECT v.chunk_id, f.path, round({D}, 6) AS distance FROM vecs v JOIN files f ON v.file_id = f.id WHERE f.path LIKE '/src3/%' ORDER BY {D}, v.chunk_id LIMIT 10")
def knn_prefilter(spark, sf_dir):
    g = adapters.graph(spark, sf_dir)
    return vectors.search(g.vectors, g.files, _query_vector(spark, sf_dir), 10, "/src3", prefilter=True).select("chunk_id", "path", F.round("distance", 6).alias("distance"))


@query(f"WITH {NODES} SELECT round(list_cosine_distance(a.e, b.e), 6) AS distance FROM vecs a, vecs b WHERE a.chunk_id = 3 AND b.chunk_id = 8")
def chunk_distance(spark, sf_dir):
    return vectors.chunk_distance(adapters.graph(spark, sf_dir).vectors, 3, 8).select(F.round("distance", 6).alias("distance"))


@query(f"WITH {NODES} SELECT chunk_id, round(1 - {D}, 6) AS similarity FROM vecs ORDER BY {D}, chunk_id LIMIT 10")
def similarity_score(spark, sf_dir):
    g = adapters.graph(spark, sf_dir)
    found = vectors.search(vectors.with_norms(g.vectors), g.files, _query_vector(spark, sf_dir))
    return found.select("chunk_id", F.round("similarity", 6).alias("similarity"))


RELATED = f"""WITH {NODES}, hits AS (SELECT k.chunk_id FROM (SELECT *, {D} AS d FROM vecs ORDER BY d, chunk_id LIMIT 10) k JOIN files f ON k.file_id = f.id),
  pairs AS (SELECT h.chunk_id AS hit, y.chunk_id AS near, sum(1.0::DOUBLE) AS total_weight, min(g.r) AS relation FROM hits h JOIN entities x ON x.chunk_id = h.chunk_id JOIN edges g ON g.s = x.id JOIN entities y ON g.t = y.id WHERE y.chunk_id <> h.chunk_id GROUP BY ALL)
  SELECT hit, (row_number() OVER (PARTITION BY hit ORDER BY total_weight DESC, near) - 1)::INT AS place, near, total_weight, relation FROM pairs"""


def _related(hits: DataFrame) -> DataFrame:
    one = hits.select(F.col("chunk_id").alias("hit"), F.posexplode("related").alias("place", "r"))
    return one.select("hit", "place", F.col("r.chunk_id").alias("near"), F.col("r.total_weight").alias("total_weight"), F.col("r.relation").alias("relation"))


@query(f"{RELATED} QUALIFY place < 5")
def search_with_relations(spark, sf_dir):
    g = adapters.graph(spark, sf_dir)
    return _related(vectors.search_with_relations(g.vectors, g.files, _query_vector(spark, sf_dir), entities=g.entities, edges=g.edges))


@query(f"""WITH {NODES}, hits AS (SELECT k.chunk_id FROM (SELECT *, {D} AS d FROM vecs ORDER BY d, chunk_id LIMIT 3) k JOIN files f ON k.file_id = f.id),
  one AS (SELECT DISTINCT h.chunk_id AS hit, g.t AS at FROM hits h JOIN entities x ON x.chunk_id = h.chunk_id JOIN edges g ON g.s = x.id),
  steps AS (SELECT 1 AS step, h.chunk_id AS hit, y.chunk_id AS near, g.r FROM hits h JOIN entities x ON x.chunk_id = h.chunk_id JOIN edges g ON g.s = x.id JOIN entities y ON g.t = y.id
    UNION ALL SELECT 2, o.hit, y.chunk_id, g.r FROM one o JOIN edges g ON g.s = o.at JOIN entities y ON g.t = y.id JOIN entities z ON z.id = o.at),
  sums AS (SELECT hit, near, step, count(*)::DOUBLE AS total_weight, min(r) AS relation FROM steps WHERE hit <> near GROUP BY hit, near, step),
  pairs AS (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY hit, near ORDER BY step) = 1)
  SELECT hit, (row_number() OVER (PARTITION BY hit ORDER BY total_weight DESC, near) - 1)::INT AS place, near, total_weight, relation FROM pairs QUALIFY place < 10""")
def graph_search(spark, sf_dir):
    g = adapters.graph(spark, sf_dir)
    return _related(vectors.search_with_relations(g.vectors, g.files, _query_vector(spark, sf_dir), 3, entities=g.entities, edges=g.edges, limit=10, min_weight=0.5, depth=2))


# -- paths, chunks, answers, streams

BLACK, WHITE = [r"/src1[0-9]/", r"7\.txt$", "**/*.go"], [r"/en/.*77\.txt$"]


@query(f"WITH {NODES} SELECT path FROM files WHERE NOT (regexp_matches(path, '/src1[0-9]/') OR regexp_matches(path, '7\\.txt$')) OR regexp_matches(path, '/en/.*77\\.txt$')")
def filter_files(spark, sf_dir):
    return adapters.graph(spark, sf_dir).files.filter(filters.index_file(F.col("path"), BLACK, WHITE)).select("path")


@query(f"WITH {NODES}, d AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM files) SELECT folder FROM d WHERE (folder = '/src1' OR folder LIKE '/src1/%' OR folder = '/src2' OR folder LIKE '/src2/%' OR folder = '/src12' OR folder LIKE '/src12/%') AND NOT (folder LIKE '%/fr/%' OR folder LIKE '%/fr' OR regexp_matches(folder, '/e[^/]$'))")
def filter_dirs(spark, sf_dir):
    folders = adapters.graph(spark, sf_dir).files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).distinct()
    return folders.filter(filters.index_directory(F.col("folder"), ["/src1", "/src2", "/src12"], ["fr", "e?"]))


EXTENSIONS = (*LANGUAGES, ".JS", ".txt", "")
TAGS = " ".join(f"WHEN {n} THEN '{tag}'" for n, tag in enumerate(LANGUAGES.values()))


@query(f"SELECT doc_id, CASE doc_id % {len(EXTENSIONS)} {TAGS} ELSE '' END AS lang_tag FROM documents")
def language_tag(spark, sf_dir):
    end = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.pmod("doc_id", F.lit(len(EXTENSIONS))) + 1).cast("int"))
    return adapters.load(spark, sf_dir, "documents").select("doc_id", language(F.concat(F.lit("/a.b/x"), end)).alias("lang_tag"))


LISTED = ", ".join(f"'{name}'" for name in extract.COMMON)
TRIED = (*extract.COMMON, "Ab", "abcd", "Abcd", "abcD", "Ünder", "ÜNDER", "Engine", "mains")


@query(f"""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE ([{", ".join(f"'{name}'" for name in TRIED)}])[(p_partkey // 2) % {len(TRIED)} + 1] END AS name FROM part)
SELECT p_partkey, name, octet_length(encode(name)) >= 4 AND name NOT IN ({LISTED}) AND regexp_matches(name, '[A-Z]') AS worth, regexp_matches(name, '^[A-Z]') AS capital FROM t""")
def named_entities(spark, sf_dir):
    """Every name of the stop list comes up, and names that differ from them by little."""
    place = (F.floor(F.col("p_partkey") / 2) % len(TRIED) + 1).cast("int")
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.element_at(F.array(*map(F.lit, TRIED)), place))
    rows = adapters.load(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return rows.select("p_partkey", "name", extract.worth_naming(F.col("name")).alias("worth"), extract.is_capitalized(F.col("name")).alias("capital"))


@query("SELECT p_partkey, CASE WHEN length(p_name) > 9 THEN left(p_name, 9) || '...' ELSE p_name END AS short, '  ' || p_name || chr(10) || '  ' || p_type AS indented FROM part")
def truncate_and_indent(spark, sf_dir):
    rows = adapters.load(spark, sf_dir, "part")
    return rows.select("p_partkey", chunker.truncate(F.col("p_name"), 9).alias("short"), indent(F.concat_ws("\n", "p_name", "p_type"), "  ").alias("indented"))


CHUNKED = """WITH RECURSIVE d AS (
  SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text))::BIGINT AS n FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents WHERE text IS NOT NULL
), p AS (
  SELECT doc_id, k, (sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1)::BIGINT AS place, count(*) OVER (PARTITION BY doc_id) AS lines FROM s
), e AS (
  SELECT doc_id, h, n, coalesce(ends, []) AS ends FROM d LEFT JOIN (SELECT doc_id, list(place ORDER BY k) AS ends FROM p WHERE k < lines GROUP BY doc_id) USING (doc_id)
), w AS (
  SELECT doc_id, 0::BIGINT AS start, -1::BIGINT AS a, -1::BIGINT AS b FROM e WHERE n > 512
  UNION ALL
  SELECT doc_id, CASE WHEN b1 <= a1 THEN a1 + 100 WHEN b1 >= n THEN n ELSE a1 + 448 END, CASE WHEN b1 - a1 >= 10 THEN a1 ELSE -1 END, b1
  FROM (SELECT doc_id, n, a1, CASE WHEN stop < n AND coalesce(list_max(list_filter(ends, lambda x: x < stop)), -1) >= a1 THEN list_max(list_filter(ends, lambda x: x < stop)) + 1 WHEN stop < n THEN least(a1, stop) ELSE stop END AS b1
    FROM (SELECT w.doc_id, n, ends, least(start + 512, n) AS stop, CASE WHEN start = 0 THEN 0 ELSE coalesce(list_min(list_filter(ends, lambda x: x >= start)) + 1, n) END AS a1 FROM w JOIN e USING (doc_id) WHERE start < n))
), c AS (
  SELECT doc_id, a, b FROM w WHERE a >= 0 UNION ALL SELECT doc_id, 0, n FROM e WHERE n BETWEEN 10 AND 512
)
SELECT doc_id, a AS start_byte, b AS end_byte,
  (len(list_filter(ends, lambda x: x < a)) + 1)::INT AS start_line, len(list_filter(ends, lambda x: x < b))::INT AS end_line,
  decode(unhex(substr(h, 2 * a + 1, 2 * (b - a)))) AS content
FROM c JOIN e USING (doc_id)"""


@query(CHUNKED)
def chunk_docs(spark, sf_dir):
    return chunker.chunks(adapters.load(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT 'u' || user_id AS source, 'USER' AS source_type, event_type AS target, '' AS target_type, 'did' AS relation_type, event_id AS chunk_id, user_id AS file_id FROM events WHERE json_extract(props, '$.k')::INT % 5 <> 0")
def parse_edges(spark, sf_dir):
    """Answers made of events; every fifth names a chunk that isn't there and has a bad line."""
    e = adapters.load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    good = F.concat(F.lit('{"chunk": 1, "Source": "u'), F.col("user_id").cast("string"), F.lit('", "source_type": "USER", "target": "'), F.col("event_type"), F.lit('", "target_type": null, "relation_type": "did"}'))
    bad = F.lit('{"chunk": 2, "source": "x"}\n{"chunk": "1"}\n{"chunk": 1,},')
    answer = F.concat(F.lit("```json\nHere they are\n"), F.when(k % 5 == 0, bad).otherwise(good), F.lit("\n```"))
    meaning = F.create_map(F.lit(1), F.struct(F.col("event_id").alias("chunk_id"), F.col("user_id").alias("file_id")))
    return extract.parse_answers(e.select(answer.alias("answer"), meaning.alias("meaning")))


SESSIONS = """WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), n AS (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= 3600000000 THEN 0 ELSE 1 END AS new FROM e), s AS (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS k FROM n)
SELECT user_id, min(us) AS first_us, max(us) + 3600000000 AS fire_us, count(*) AS n FROM s GROUP BY user_id, k"""


@query(SESSIONS)
def debounce_sessions(spark, sf_dir):
    found = debounce.sessions(adapters.load(spark, sf_dir, "events"), "user_id", "ts", "1 hour")
    return found.select("user_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("fire_ts").alias("fire_us"), "n")


@query(SESSIONS)
def debounce_batch(spark, sf_dir):
    found = debounce.batch_sessions(adapters.load(spark, sf_dir, "events"), "user_id", "ts", 3600)
    return found.select("user_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("fire_ts").alias("fire_us"), "n")


OPS = {"click": "write", "view": "create", "purchase": "remove", "signup": "rename", "error": "chmod"}


@query("SELECT CASE event_type WHEN 'click' THEN 'write' ELSE 'create' END AS op, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def relevant_events(spark, sf_dir):
    ops = F.create_map(*[F.lit(x) for pair in OPS.items() for x in pair])
    events = adapters.load(spark, sf_dir, "events").select(F.try_element_at(ops, F.col("event_type")).alias("op"))
    return debounce.relevant(events).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


# -- single chunks and files, deletes, states


@query(f"WITH {NODES} SELECT 'one' AS what, * FROM chunks WHERE chunk_id = 12 UNION ALL SELECT 'of a file', * FROM chunks WHERE file_id = 31 UNION ALL SELECT 'all', * FROM chunks")
def chunk_lookups(spark, sf_dir):
    rows = adapters.graph(spark, sf_dir).chunks
    found = {"one": lookups.chunk(rows, 12), "of a file": lookups.chunks_of_file(rows, 31), "all": lookups.all_chunks(rows)}
    parts = [part.select(F.lit(what).alias("what"), "*") for what, part in found.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"WITH {NODES} SELECT id, path FROM files WHERE id <> 42")
def delete_file(spark, sf_dir):
    files = adapters.graph(spark, sf_dir).files
    path = files.filter("id = 42").select("path").first()[0]
    return registry.delete_file(files, path).select("id", "path")


@query(f"WITH {NODES} SELECT s AS source_entity_id, t AS target_entity_id, r AS relation_type, chunk_id FROM edges WHERE chunk_id <> 7")
def delete_edges(spark, sf_dir):
    return registry.delete_edges(adapters.graph(spark, sf_dir).edges, 7).drop("weight")


@query(f"WITH {NODES}, d AS (SELECT user_id AS id, min(CASE WHEN user_id % 2 = 0 THEN event_type END) AS m FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT f.id, CASE WHEN d.id IS NULL THEN status ELSE 'failed' END AS status, (retry_count + CASE WHEN d.id IS NULL THEN 0 ELSE 1 END)::INT AS retry_count, CASE WHEN d.id IS NOT NULL THEN coalesce(m, 'unknown error') END AS error_message FROM files f LEFT JOIN d USING (id)")
def mark_failed(spark, sf_dir):
    """Half of the failures have no message."""
    failures = adapters.load(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("id"), F.when(F.col("user_id") % 2 == 0, F.col("event_type")).alias("message"))
    return registry.mark_failed(adapters.graph(spark, sf_dir).files, failures).select("id", "status", "retry_count", "error_message")


@query(f"WITH {NODES} SELECT id, CASE WHEN id IN (SELECT user_id FROM events) THEN 'processing' ELSE status END AS status FROM files")
def mark_processing(spark, sf_dir):
    ids = adapters.load(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    return registry.mark_processing(adapters.graph(spark, sf_dir).files, ids).select("id", "status")


@query(f"WITH {NODES} SELECT path, (path LIKE '%src1/%' OR regexp_matches(path, 'src1/')) AS named, regexp_matches(path, '/[0-9]*7\\.txt$') AS ended, (regexp_matches(path, '^/src[12]/') AND NOT path LIKE '%/fr/%' AND NOT regexp_matches(path, '3\\.txt$')) AS followed FROM files")
def path_patterns(spark, sf_dir):
    path = F.col("path")
    named, ended = filters.matches_pattern(path, "src1/"), filters.matches_pattern(path, "*7.txt")
    followed = filters.daemon_filter(path, ["/src1", "/src2"], ["fr"], [r"3\.txt$"], [])
    return adapters.graph(spark, sf_dir).files.select("path", named.alias("named"), ended.alias("ended"), followed.alias("followed"))


@query("SELECT 'region.parquet' AS name")
def walk_one_file(spark, sf_dir):
    """A path of one file isn't filtered."""
    found = files.walk(spark, f"{sf_dir}/region.parquet", [".*parquet"])
    return found.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"))


@query("SELECT 'created_by' AS key, 'lodestrand' AS value UNION ALL SELECT 'embedding_dim', '3' UNION ALL SELECT 'k', 'second' UNION ALL SELECT 'schema_version', '2.4.0'")
def store_meta(spark, sf_dir):
    store = GraphStore.create(spark, shared_path(spark, "store"), 3)
    for value in ("first", "second"):
        store.set_meta("k", value)
    return store.meta


@query(f"""WITH {NODES}, q AS (SELECT row_number() OVER (ORDER BY path) AS id, path FROM files)
SELECT id, path, CASE WHEN id <= 60 AND id % 7 <> 0 THEN 'indexed' ELSE 'pending' END AS status, CASE WHEN id <= 60 AND id % 7 = 0 THEN 1 ELSE 0 END AS retry_count, CASE WHEN id <= 60 AND id % 7 <> 0 THEN 1 ELSE 0 END::BIGINT AS n_chunks FROM q""")
def queue_batches(spark, sf_dir):
    """A store's queue after three batches of twenty files, of which every seventh fails."""
    store = GraphStore.create(spark, shared_path(spark, "store"), 1)
    rows = adapters.graph(spark, sf_dir).files.select("path", "last_mod_time", "content_hash", F.lit(0).alias("seq"))
    workqueue.enqueue(store, rows)

    def index(batch: DataFrame):
        chunks = batch.select(F.col("id").alias("file_id"), F.col("path").alias("content_snippet"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"))
        return chunks, batch.filter("id % 7 = 0").select("id", F.lit(None).cast("string").alias("message"))

    tops = [r["id"] for r in store.files.orderBy("path").select("id").limit(60).collect()]
    for _ in range(3):
        workqueue.index_once(store, index, 20)
        # Failed ones wait again, with a later time, behind the rest.
    chunks = store.chunks.groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("n_chunks"))
    assert tops == list(range(1, len(tops) + 1))
    return store.files.join(chunks, "id", "left").select("id", "path", "status", "retry_count", F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks"))


class TwoLines:
    """A model that names one relation twice, and fails over one nation."""

    def complete(self, prompt: str) -> str:
        if "FRANCE" in prompt or "NATION_6" in prompt:
            return '{"chunk": 1, "source": 5}'
        line = '{"chunk": %d, "source": "A", "source_type": "T", "target": "B", "target_type": "T", "relation_type": "%s"}'
        return "\n".join(line % (n, relation) for n in range(1, prompt.count("## Chunk") + 1) for relation in ("uses", "calls"))


@query("""WITH n AS (SELECT n_nationkey::BIGINT AS chunk_id, n_name, n_nationkey // 5 AS batch FROM nation), bad AS (SELECT DISTINCT batch FROM n WHERE n_name LIKE '%FRANCE%' OR n_name LIKE '%NATION_6%')
SELECT chunk_id, CASE WHEN batch IN (SELECT batch FROM bad) THEN 'failed' ELSE 'calls' END AS outcome FROM n""")
def extract_last_line(spark, sf_dir):
    """Of two lines about one edge the last stands, and a bad answer fails its own chunks alone."""
    nations = adapters.load(spark, sf_dir, "nation")
    chunks = nations.select(F.col("n_nationkey").cast("long").alias("chunk_id"), F.lit(1).cast("long").alias("file_id"), F.lit("/n").alias("path"), F.col("n_name").alias("content_snippet"))
    raw = settled(extract.extract(chunks, TwoLines(), 5), "raw")
    none = lambda schema: spark.createDataFrame([], schema)
    _, edges = extract.store_edges(none(schemas.ENTITIES), none(schemas.EDGES), raw.filter("error IS NULL"))
    return edges.select("chunk_id", F.col("relation_type").alias("outcome")).union(raw.filter("error IS NOT NULL").select("chunk_id", F.lit("failed").alias("outcome")))


@query("SELECT 'u' || user_id AS source, '' AS source_type, event_type AS target, '' AS target_type, 'did' AS relation_type FROM events WHERE json_extract(props, '$.k')::INT % 5 <> 0")
def parse_array_answers(spark, sf_dir):
    """Answers that are JSON arrays; every fifth is none."""
    e = adapters.load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    good = F.concat(F.lit('[{"source": "u'), F.col("user_id").cast("string"), F.lit('", "target": "'), F.col("event_type"), F.lit('", "relation_type": "did"}]'))
    bad = F.when(k % 2 == 0, F.lit('{"source": "x"}')).otherwise(F.lit('["x"]'))
    return extract.parse_array_answers(e.select(F.when(k % 5 == 0, bad).otherwise(good).alias("answer")))


FLAGSHIP = "count_top10"
