"""Methods as whole plans, ingestion, and operators behind providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import providers as P
from graphloom.lineage import written
from graphloom.operators import meta as M
from graphloom.operators import trees as T
from graphloom.operators.prize_tree import prize_tree
from graphloom.plans import methods
from graphloom.plans.operators import Context
from graphloom.queries.ops import _membership, _reports
from graphloom.queries.registry import query, whole
from graphloom.sources import commerce as K
from graphloom.sources import files as S


def context(spark, sf, method: str) -> Context:
    """The supplies graph with orders as chunks. Edges are merged from lines once and written for methods that use them, as each step reads them again."""
    e = K.trade_edges(spark, sf, sources=True).filter("relation = 'supplies'")
    if "edges" in methods.profile(method)["needs"]:
        e = written(e)
    return Context(K.nodes(spark, sf, ("supplier", "part")), e, K.chunks(spark, sf), K.chunk_parts(spark, sf), _membership(spark, sf), _reports(spark, sf))


@query(f"""WITH {K.SQL_PARTS}, {K.SQL_LINES}, n AS (SELECT 'part:' || p_partkey AS entity_name, 'part:' || p_partkey || ' part ' || p_name || ' ' || p_brand || ' ' || p_type AS t FROM part),
raw AS (SELECT entity_name, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS term FROM n), tf AS (SELECT entity_name, term, count(*) AS tf FROM raw WHERE length(term) >= 2 GROUP BY ALL), idf AS (SELECT term, ln((1 + (SELECT count(*) FROM n)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
norms AS (SELECT entity_name, sqrt(sum(tf * idf * tf * idf)) AS norm FROM tf JOIN idf USING (term) GROUP BY entity_name), q0 AS (SELECT unnest(['blue', 'ring', 'brand', '11']) AS term), q AS (SELECT term, idf / (SELECT sqrt(sum(idf * idf)) FROM q0 JOIN idf USING (term)) AS q FROM q0 JOIN idf USING (term)),
s AS (SELECT entity_name, round(sum(tf * idf * q) / any_value(norm), 6) AS score FROM tf JOIN q USING (term) JOIN idf USING (term) JOIN norms USING (entity_name) GROUP BY entity_name),
seeds AS (SELECT entity_name, row_number() OVER (ORDER BY score DESC, entity_name) - 1 AS position FROM s QUALIFY position < 5),
co AS (SELECT DISTINCT a.entity_name AS entity_name, b.entity_name AS node, a.chunk_id FROM mentioned a JOIN mentioned b ON a.chunk_id = b.chunk_id AND a.entity_name <> b.entity_name WHERE a.entity_name IN (SELECT entity_name FROM seeds)),
own AS (SELECT chunk_id, entity_name, position FROM mentioned JOIN seeds USING (entity_name)), b AS (SELECT chunk_id, count(DISTINCT node) AS c FROM co GROUP BY chunk_id)
SELECT chunk_id, min(position) AS position, coalesce(any_value(c), 0) AS relation_counts FROM own LEFT JOIN b USING (chunk_id) GROUP BY chunk_id ORDER BY position, relation_counts DESC, chunk_id LIMIT 20""")
def basic_local_plan(spark, sf):
    """Lexical seeds, their neighbours by shared orders, and the orders that mention them."""
    from graphloom.operators import enrich as A
    from graphloom.operators import entities as E
    from graphloom.operators import relations as L

    parts = K.nodes(spark, sf, ("part",))
    m = K.chunk_parts(spark, sf)
    # five seeds and the edges near them are used several times: each is found once and written
    seeds = written(E.tfidf(parts, "blue ring Brand#11", 5).select("entity_name", (F.col("tfidf_rank") - 1).alias("position")))
    # only edges at the seeds matter, so co-occurrence starts from their chunks
    near = written(m.join(written(m.join(F.broadcast(seeds), "entity_name", "left_semi").select("chunk_id").distinct()), "chunk_id", "left_semi"))
    return L.occurrence(m, written(A.cooccurrence(near)), seeds, 20)


@query()
def method_basic_local(spark, sf):
    return methods.run("basic_local", "blue ring Brand#11", context(spark, sf, "basic_local"))


@query()
def method_lightrag(spark, sf):
    return methods.run("lightrag", "supplies part:7", context(spark, sf, "lightrag"), top_k=5)


@query()
def method_fastgraphrag(spark, sf):
    return methods.run("fastgraphrag", "blue ring Brand#11", context(spark, sf, "fastgraphrag"), top_k=5)


@query()
def method_basic_global(spark, sf):
    return methods.run("basic_global", "overview", context(spark, sf, "basic_global"))


@query(r"""SELECT page_id AS doc_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style|title)[^>]*>.*?</(script|style|title)>', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS content FROM pages""")
def ingest_pages_corpus(spark, sf):
    return S.pages_corpus(K.table(spark, sf, "pages"))


@query("SELECT c_name AS title, c_mktsegment AS content, 'c_custkey=' || c_custkey || ';c_nationkey=' || c_nationkey AS meta FROM customer")
def ingest_records(spark, sf):
    c = K.table(spark, sf, "customer").select(F.col("c_name").alias("title"), F.col("c_mktsegment").alias("text"), "c_custkey", "c_nationkey")
    out = S.records(c, "customer")
    return out.select("title", "content", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("meta"))


@query(f"WITH {K.SQL_NODES}, {K.SQL_PLACES}, f AS (SELECT entity_name FROM nodes WHERE entity_type IN ('nation', 'region') ORDER BY entity_name LIMIT 30) SELECT src, tgt FROM places WHERE src IN (SELECT entity_name FROM f) AND tgt IN (SELECT entity_name FROM f) ORDER BY src, tgt LIMIT 8")
def graph_sample(spark, sf):
    return S.sample_graph(K.nodes(spark, sf, ("nation", "region")), K.place_edges(spark, sf), 30, 8)[1].select("src", "tgt")


@whole("o_orderkey < 60")
@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'yes' ELSE NULL END AS status FROM orders WHERE o_orderkey < 60")
def json_recovery(spark, sf, rows="o_orderkey < 60"):
    k = F.col("o_orderkey") % 3
    said = F.when(k == 0, 'Sure:\n```json\n{"status": "ok"}\n```').when(k == 1, "status: yes\nmore").otherwise("nothing here")
    return K.table(spark, sf, "orders").filter(rows).select("o_orderkey", S.json_field(said, "$.status").alias("status"))


def _questions(spark, sf):
    b = K.table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("id"), F.concat(F.lit("Find Acme Corp and New York, then "), "text").alias("question"))


@query(r"""WITH l AS (SELECT item_id AS id, regexp_extract_all('Find Acme Corp and New York, then ' || regexp_replace(text, '[À-ÖØ-öø-ÿŒœ]', '_', 'g'), '\b[A-Z][a-z]+(?: [A-Z][a-z]+){0,2}\b') AS l FROM benchmark), e AS (SELECT id, unnest(l) AS entity_name, generate_subscripts(l, 1) AS i FROM l)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY min(i)) - 1)::INT AS position, entity_name FROM e GROUP BY id, entity_name""")
def meta_extract_entities(spark, sf):
    return M.extract_entities(_questions(spark, sf))


@query("SELECT n_nationkey::BIGINT AS id, p::INT AS position, q AS question FROM nation, (VALUES (0, 'who lives'), (1, 'who leaves'), (2, 'when')) v(p, q)")
def meta_decompose(spark, sf):
    return M.decompose(K.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("who lives and who leaves; when?").alias("question")))


@query("SELECT r_regionkey::BIGINT AS id, 'The region ' || r_name || ' is number ' || r_regionkey || '.' AS answer FROM region")
def meta_answer(spark, sf):
    r = K.table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"), "r_name")
    q = r.select("id", F.lit("Which region has this number?").alias("question"))
    c = r.select("id", F.lit(0).alias("position"), F.concat(F.lit("Nothing here. The region "), "r_name", F.lit(" is number "), F.col("id").cast("string"), F.lit(".")).alias("content"))
    return M.answer(q, c)


@query("SELECT r_regionkey::BIGINT AS id, p::INT AS position, k AS rank, round(1 - k / 2.0, 6)::DOUBLE AS score FROM region, (VALUES (2, 0), (0, 1)) v(p, k)")
def meta_rerank(spark, sf):
    r = K.table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"))
    items = r.join(spark.createDataFrame([(0, "green tea leaves"), (1, "coal"), (2, "tea from green hills")], "position int, content string"))
    return M.rerank(r.withColumn("question", F.lit("green hills tea")), items, 2).withColumn("rank", F.col("rank").cast("int"))


@query(f"""WITH RECURSIVE {K.SQL_PLACES}, e AS (SELECT src, tgt, relation FROM places WHERE relation = 'in_region'), adj AS (SELECT src, tgt FROM e UNION SELECT tgt, src FROM e), reach(x, y) AS (SELECT src, src FROM adj UNION SELECT r.x, a.tgt FROM reach r JOIN adj a ON r.y = a.src),
c AS (SELECT x, min(y) AS c FROM reach GROUP BY x), t AS (SELECT c FROM c GROUP BY c ORDER BY count(*) DESC, c LIMIT 1) SELECT src, tgt, relation FROM e WHERE src IN (SELECT x FROM c SEMI JOIN t USING (c))""")
def meta_pcst_fallback(spark, sf):
    return M.prune_subgraph(K.place_edges(spark, sf).filter("relation = 'in_region'").select("src", "tgt", "relation"))


@query()
def meta_pcst(spark, sf):
    """For each region, a tree over its nations, customers and suppliers: prizes are tens of orders and a supplier's one, costs fall with numbers of lines.

    A cost is halved for each doubling of the lines that a customer ordered or a supplier delivers, which leaves few different ones, and so few rounds.
    """
    n = K.table(spark, sf, "nation")
    scope = F.col("n_regionkey").alias("scope")
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    cost = lambda most: (most / F.pow(F.lit(2.0), F.floor(F.log2(1.0 + F.coalesce("lines", F.lit(0)))))).alias("cost")
    lines = K.table(spark, sf, "lineitem")
    per_order = lines.groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    orders = K.table(spark, sf, "orders").join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.count("*").alias("prize"), F.sum("lines").alias("lines"))
    delivered = lines.groupBy("l_suppkey").agg(F.count("*").alias("lines"))
    c = K.table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    s = K.table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(delivered, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    nodes = c.select(scope, name("customer", "c_custkey").alias("node"), (F.coalesce("prize", F.lit(0)) / 10).cast("int").cast("double").alias("prize")).union(s.select(scope, name("supplier", "s_suppkey"), F.lit(1.0)))
    edges = c.select(scope, name("customer", "c_custkey").alias("src"), name("nation", "n_nationkey").alias("tgt"), cost(16.0)).union(s.select(scope, name("supplier", "s_suppkey"), name("nation", "n_nationkey"), cost(256.0)))
    edges = edges.union(n.select(scope, name("nation", "n_nationkey"), name("region", "n_regionkey"), F.lit(2.0)))
    return prize_tree(nodes, edges)


@query()
def tree_balanced(spark, sf):
    return T.balanced_clusters(K.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 8)


@query()
def tree_soft_clusters(spark, sf):
    v = K.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return T.soft_clusters(v, 4)


@query()
def tree_of_summaries(spark, sf):
    leaves = K.table(spark, sf, "nation").select(F.col("n_name").alias("id"), F.concat_ws(" ", "n_name", F.lit("in region"), F.col("n_regionkey").cast("string")).alias("content"))
    return T.build(leaves, lambda v: T.balanced_clusters(v, 5), lambda c: c, 2)


@query()
def embed_distinct_rows(spark, sf):
    return P.embed(K.table(spark, sf, "part").select("p_partkey", "p_name"), "p_name")
