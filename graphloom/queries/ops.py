"""Entity, relationship, chunk and community operators, and the plans made of them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.expansion import expand_query
from graphloom.operators import agents as AG
from graphloom.operators import communities as CO
from graphloom.operators import context as CX
from graphloom.operators import entities as E
from graphloom.operators import graph as G
from graphloom.operators import leiden as LE
from graphloom.operators import relations as L
from graphloom.operators import reports as RE
from graphloom.queries.registry import query, whole
from graphloom.sources import commerce as K

_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


def names(spark, *some):
    return spark.createDataFrame([(n, i) for i, n in enumerate(some)], "entity_name string, position int")


def _vectors(spark, sf):
    """Embeddings as vectors of the parts of the same number."""
    v = K.table(spark, sf, "embeddings")
    return v.select(F.concat(F.lit("part:"), F.col("vec_id").cast("string")).alias("entity_name"), "embedding")


def _ask(spark, sf, *ids):
    return K.table(spark, sf, "embeddings").filter(F.col("vec_id").isin(*ids)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


_HITS = f"hits AS (SELECT a.vec_id AS query_id, 'part:' || b.vec_id AS entity_name, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, 'part:' || b.vec_id) AS hit FROM embeddings a, embeddings b WHERE a.vec_id IN (0, 5) QUALIFY hit <= 8)"
_DEGREE = "deg AS (SELECT node, count(*) AS rank FROM (SELECT src AS node FROM edges UNION ALL SELECT tgt FROM edges) GROUP BY node)"


@query(f"WITH {K.SQL_EDGES}, {_DEGREE}, {_HITS} SELECT query_id, entity_name, score, hit, coalesce(rank, 0) AS rank FROM hits LEFT JOIN deg ON node = entity_name")
def entity_vdb(spark, sf):
    return E.vdb(_vectors(spark, sf), _ask(spark, sf, 0, 5), 8, K.edges(spark, sf))


@query(f"SELECT a.vec_id AS query_id, 'part:' || b.vec_id AS entity_name, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, 'part:' || b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id IN (0, 5) QUALIFY rank <= 4")
def entity_search_expanded(spark, sf):
    # distinct names are as many as asked for, so no expansion is searched
    ask = _ask(spark, sf, 0, 5)
    return E.search_expanded(_vectors(spark, sf), ask, ask, 4)


@query(f"""WITH n AS (SELECT 'kind:' || (vec_id % 6) AS name, vec_id, embedding FROM embeddings), c AS (SELECT a.vec_id AS ask, b.name, b.vec_id, round({_COS}, 6) AS score FROM embeddings a, n b WHERE a.vec_id IN (0, 5, 7, 9, 11)),
own AS (SELECT ask AS query_id, name, score FROM c WHERE ask IN (0, 5) QUALIFY row_number() OVER (PARTITION BY ask ORDER BY score DESC, name) <= 12), short AS (SELECT query_id FROM own GROUP BY query_id HAVING count(DISTINCT name) < 6),
more AS (SELECT CASE WHEN ask = 7 THEN 0 ELSE 5 END AS query_id, name, round(score * 0.9, 6) AS score FROM (SELECT * FROM c WHERE ask IN (7, 9, 11)) WHERE CASE WHEN ask = 7 THEN 0 ELSE 5 END IN (SELECT query_id FROM short) QUALIFY row_number() OVER (PARTITION BY CASE WHEN ask = 7 THEN 0 ELSE 5 END ORDER BY score DESC, name) <= 6)
SELECT query_id, name AS entity_name, max(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, name) AS rank FROM (SELECT * FROM own UNION ALL SELECT * FROM more) GROUP BY query_id, name QUALIFY rank <= 6""")
def entity_search_expansions(spark, sf):
    """Many vectors share a name, so that a question's own hits hold too few names and its expansions are searched."""
    v = K.table(spark, sf, "embeddings")
    named = v.select(F.concat(F.lit("kind:"), (F.col("vec_id") % 6).cast("string")).alias("entity_name"), "embedding")
    more = v.filter("vec_id in (7, 9, 11)").select(F.when(F.col("vec_id") == 7, 0).otherwise(5).cast(dict(v.dtypes)["vec_id"]).alias("query_id"), F.col("embedding").alias("q"))
    return E.search_expanded(named, _ask(spark, sf, 0, 5), more, 6)


@query(f"""WITH {K.SQL_PLACES}, t AS (SELECT n_nationkey AS id, 'nation:' || n_nationkey AS topic FROM nation), s AS (SELECT id, topic, relation, src = topic AS head FROM t JOIN places ON src = topic OR tgt = topic),
r AS (SELECT id, topic, relation, max(head) AS head, count(*) AS n FROM s GROUP BY ALL), f AS (SELECT *, round(n / sum(n) OVER (PARTITION BY id), 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, relation) <= 2),
c AS (SELECT DISTINCT id, topic, relation, head, score, CASE WHEN head THEN tgt ELSE src END AS far FROM f JOIN places USING (relation) WHERE (head AND src = topic) OR (NOT head AND tgt = topic)),
x AS (SELECT id, topic, relation, head, far, CASE WHEN count(*) OVER w = 1 THEN score ELSE round(1 / count(*) OVER w, 6) END AS score FROM c WINDOW w AS (PARTITION BY id, topic, relation, head))
SELECT id::BIGINT AS id, far AS entity_name, score, relation, topic AS topic_entity, head FROM x WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, far, relation) <= 4""")
def agent_step(spark, sf):
    """From every nation over its two most frequent relations to four far ends, as rated without a provider."""
    edges = K.place_edges(spark, sf)
    topics = K.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("what is there?").alias("question"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("entity_name"))
    return AG.rate_tails(edges, AG.rate_relations(edges, topics, 2), 4)


@query(f"WITH {K.SQL_EDGES}, {_DEGREE}, s AS (SELECT unnest(['supplier:1', 'supplier:2', 'region:3']) AS s), n AS (SELECT tgt AS node FROM edges JOIN s ON src = s UNION SELECT src FROM edges JOIN s ON tgt = s) SELECT node AS entity_name, rank FROM n JOIN deg USING (node) WHERE node NOT IN (SELECT s FROM s)")
def entity_onehop(spark, sf):
    return E.onehop(K.edges(spark, sf), names(spark, "supplier:1", "supplier:2", "region:3"))


@query(f"""WITH {K.SQL_EDGES}, {_DEGREE}, n AS (SELECT DISTINCT seed, node FROM (SELECT src AS seed, tgt AS node FROM edges UNION ALL SELECT tgt, src FROM edges) WHERE seed IN ('supplier:1', 'part:7'))
SELECT seed, node AS entity_name, rank FROM n JOIN deg USING (node) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY rank DESC, node) <= 5""")
def entity_onehop_limited(spark, sf):
    return E.onehop_limited(K.edges(spark, sf), names(spark, "supplier:1", "part:7"), 5)


@query(f"""WITH t AS (SELECT a.vec_id AS f, 'part:' || b.vec_id AS e, round({_COS}, 6) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < 20 AND b.vec_id >= 20 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, 'part:' || b.vec_id) = 1)
SELECT f AS linked_from, CASE WHEN s >= 0.33 THEN e END AS entity_name, CASE WHEN s >= 0.33 THEN s END AS score, CASE WHEN s >= 0.33 THEN 'linked' ELSE 'not_found' END AS status FROM t""")
def vdb_link(spark, sf):
    return E.link(_vectors(spark, sf).filter("cast(substring(entity_name, 6) as int) >= 20"), _ask(spark, sf, *range(20)), 0.33)


@query(f"""WITH {K.SQL_NODES}, raw AS (SELECT entity_name, unnest(regexp_extract_all(lower(entity_name || ' ' || entity_type || ' ' || description), '[a-z0-9]+')) AS term FROM nodes),
tf AS (SELECT entity_name, term, count(*) AS tf FROM raw WHERE length(term) >= 2 AND term NOT IN ('a','an','the','of','in','on','at','by','for','to','and','or','is','was','with','from','as','that','this','it') GROUP BY ALL),
n AS (SELECT count(*) AS n FROM nodes), idf AS (SELECT term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY term), norms AS (SELECT entity_name, sqrt(sum(tf * idf * tf * idf)) AS norm FROM tf JOIN idf USING (term) GROUP BY entity_name),
q0 AS (SELECT unnest(['red', 'widget', 'brand', '17', 'economy']) AS term), q AS (SELECT term, idf / (SELECT sqrt(sum(idf * idf)) FROM q0 JOIN idf USING (term)) AS q FROM q0 JOIN idf USING (term)),
s AS (SELECT entity_name, round(sum(tf * idf * q) / any_value(norm), 6) AS score FROM tf JOIN q USING (term) JOIN idf USING (term) JOIN norms USING (entity_name) GROUP BY entity_name)
SELECT entity_name, score, row_number() OVER (ORDER BY score DESC, entity_name) AS tfidf_rank FROM s QUALIFY tfidf_rank <= 15""")
def entity_tfidf(spark, sf):
    return E.tfidf(K.nodes(spark, sf), "red widget Brand#17 ECONOMY", 15)


@query(f"WITH {K.SQL_EDGES}, c AS (SELECT * FROM edges WHERE relation = 'in_region' OR (relation = 'located_in' AND (src IN ('nation:1', 'nation:2') OR tgt IN ('nation:1', 'nation:2')))), x AS (SELECT src AS entity_name, 'source' AS role, src || tgt AS e FROM c UNION ALL SELECT tgt, 'target', src || tgt FROM c) SELECT entity_name, CASE WHEN min(role) = max(role) THEN min(role) ELSE 'both' END AS role, count(DISTINCT e) AS n_edges FROM x GROUP BY entity_name")
def entity_rel_node(spark, sf):
    e = K.place_edges(spark, sf)
    some = e.filter("relation = 'in_region' or src in ('nation:1', 'nation:2') or tgt in ('nation:1', 'nation:2')").select(F.concat_ws("->", "src", "tgt").alias("edge_id"))
    return E.rel_node(e, F.concat_ws("|", "src", "relation", "tgt"), some)


@query("""WITH x AS (SELECT 'region:' || n_regionkey AS head, 'in_region' AS relation, 'nation:' || n_nationkey AS tail FROM nation), r AS (SELECT head, relation, tail AS entity_name, round(1.0::DOUBLE / count(*) OVER (PARTITION BY head, relation), 6) AS score FROM x) SELECT * FROM r ORDER BY score DESC, entity_name, head, relation LIMIT 8""")
def entity_agent_fallback(spark, sf):
    r = K.table(spark, sf, "nation").select(F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("head"), F.lit("in_region").alias("relation"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("tail"))
    return E.choose_tails(r, 8)


@query("""SELECT * FROM (VALUES ('Supplier 3', 'supplier:3'), ('PART:12', 'part:12'), ('mr nation 4', 'nation:4'), ('unknown thing', NULL), ('region:1', 'region:1')) v(name, entity_name)""")
def entity_resolve_names(spark, sf):
    asked = spark.createDataFrame([("Supplier 3",), ("PART:12",), ("mr nation 4",), ("unknown thing",), ("region:1",)], "name string")
    return E.resolve(K.nodes(spark, sf), asked)


@query("""SELECT * FROM (VALUES ('the 4 supplier', 'supplier:4', 2), ('part 5 blue', 'part:5', 2), ('region 2', 'region:2', 2)) v(name, entity_name, shared)""")
def entity_resolve_fuzzy(spark, sf):
    asked = spark.createDataFrame([("the 4 supplier",), ("part 5 blue",), ("region 2",)], "name string")
    return E.resolve_fuzzy(K.nodes(spark, sf), asked).withColumn("shared", F.col("shared").cast("int"))


_ONEHOP = f"""WITH {K.SQL_EDGES}, {_DEGREE}, o AS (SELECT e.src, e.tgt, e.relation, e.weight, a.rank + b.rank AS rank FROM edges e JOIN deg a ON e.src = a.node JOIN deg b ON e.tgt = b.node WHERE src IN ('supplier:3', 'nation:3') OR tgt IN ('supplier:3', 'nation:3'))"""


@query(_ONEHOP + """, s AS (SELECT *, sum(len(string_split(src || ' ' || relation || ' ' || tgt, ' '))) OVER (ORDER BY rank DESC, weight DESC, src, tgt, relation ROWS UNBOUNDED PRECEDING) AS t FROM o) SELECT src, tgt, relation, weight, rank FROM s WHERE t <= 200""")
def relationship_onehop_ranked(spark, sf):
    return L.onehop(K.edges(spark, sf), names(spark, "supplier:3", "nation:3"), 200)


@query(f"WITH {K.SQL_EDGES} SELECT src, tgt, relation, weight FROM edges WHERE relation IN ('supplies', 'in_region') AND src IN ('part:5', 'nation:2')")
def relationship_filtered_direction(spark, sf):
    return L.directed_onehop(K.edges(spark, sf), names(spark, "part:5", "nation:2"), "outgoing", ["supplies", "in_region"])


@query(f"SELECT a.vec_id AS query_id, 'e' || b.vec_id AS edge_id, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, 'e' || b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id = 11 QUALIFY rank <= 12 AND score >= 0.2")
def relationship_vdb(spark, sf):
    v = K.table(spark, sf, "embeddings").select(F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("edge_id"), "embedding")
    return L.vdb(v, _ask(spark, sf, 11), 12, 0.2)


_SCORES = "scores AS (SELECT 'supplier:' || s_suppkey AS entity_name, round(s_acctbal / 1000, 3) AS score FROM supplier)"


def _scores(spark, sf):
    s = K.table(spark, sf, "supplier")
    return s.select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("entity_name"), F.round(F.col("s_acctbal") / 1000, 3).alias("score"))


@query(f"WITH {K.SQL_EDGES}, {_SCORES}, i AS (SELECT src AS entity_name, src || '|' || tgt AS edge_id FROM edges UNION ALL SELECT tgt, src || '|' || tgt FROM edges) SELECT edge_id, round(sum(score), 6) AS score FROM i JOIN scores USING (entity_name) GROUP BY edge_id ORDER BY score DESC, edge_id LIMIT 25")
def score_agg(spark, sf):
    return L.score_agg(_scores(spark, sf), G.incidence(K.edges(spark, sf), F.concat_ws("|", "src", "tgt")), 25)


def _modes(how):
    e = {"sum": "x + y", "average": "(x + y) / 2", "max": "greatest(x, y)"}[how]
    return f"""WITH {K.SQL_PLACES}, {_SCORES}, e AS (SELECT p.*, coalesce(a.score, 0) AS x, coalesce(b.score, 0) AS y FROM places p LEFT JOIN scores a ON a.entity_name = src LEFT JOIN scores b ON b.entity_name = tgt) SELECT src, tgt, relation, weight, round({e}, 6) AS score FROM e WHERE x <> 0 OR y <> 0 ORDER BY score DESC, src, tgt, relation LIMIT 10"""


@query(_modes("sum"))
def rel_score_sum(spark, sf):
    return L.score_ends(K.place_edges(spark, sf), _scores(spark, sf), "sum", 10)


@query(_modes("average"))
def rel_score_average(spark, sf):
    return L.score_ends(K.place_edges(spark, sf), _scores(spark, sf), "average", 10)


@query(_modes("max"))
def rel_score_max(spark, sf):
    return L.score_ends(K.place_edges(spark, sf), _scores(spark, sf), "max", 10)


@query(f"WITH {K.SQL_EDGES} SELECT relation, CASE WHEN src = 'nation:5' THEN 'head' ELSE 'tail' END AS side, count(*) AS n FROM edges WHERE (src = 'nation:5' OR tgt = 'nation:5') AND relation <> 'in_region' GROUP BY ALL ORDER BY n DESC, relation, side LIMIT 3")
def relationship_agent(spark, sf):
    return L.agent_relations(K.edges(spark, sf), "nation:5", ["in_region"], 3)


@whole("o_orderkey < 50")
@query("SELECT o_orderkey, 'ships to' AS relation, 0.7::DOUBLE AS score FROM orders WHERE o_orderkey < 50 UNION ALL SELECT o_orderkey, o_orderpriority, 0.25 FROM orders WHERE o_orderkey < 50")
def relation_score_parse(spark, sf, rows="o_orderkey < 50"):
    o = K.table(spark, sf, "orders").filter(rows)
    said = F.concat(F.lit("1. {ships to (Score: 0.7)}: likely. 2. {"), "o_orderpriority", F.lit(" (Score: 0.25)} less so; {not scored}"))
    return o.select("o_orderkey", F.explode(L.parse_scores(said)).alias("s")).select("o_orderkey", "s.*")


_EDGE_CHUNKS = f"""WITH {K.SQL_LINES}, {K.SQL_CHUNKS}, m AS (SELECT src, tgt, relation, list_sort(list_distinct(list(chunk_id))) AS ids FROM lines WHERE src = 'part:3' OR tgt = 'part:3' GROUP BY ALL),
p AS (SELECT row_number() OVER (ORDER BY src, tgt, relation) - 1 AS position, src || '|' || tgt AS edge_id, ids FROM m), x AS (SELECT position, edge_id, unnest(ids) AS chunk_id, generate_subscripts(ids, 1) - 1 AS place FROM p)"""


def _edge_chunks(spark, sf):
    from pyspark.sql import Window as W

    e = K.trade_edges(spark, sf, sources=True).filter("src = 'part:3' or tgt = 'part:3'")
    return e.select((F.row_number().over(W.orderBy("src", "tgt", "relation")) - 1).alias("position"), F.concat_ws("|", "src", "tgt").alias("edge_id"), "source_ids")


@query(_EDGE_CHUNKS + """, f AS (SELECT chunk_id, min((position, place)) AS o FROM x GROUP BY chunk_id), g AS (SELECT chunk_id, o[1] AS position, o[2]::INT AS place, tokens, sum(tokens) OVER (ORDER BY o[1], o[2], chunk_id ROWS UNBOUNDED PRECEDING) AS t FROM f JOIN chunks USING (chunk_id)) SELECT chunk_id, position, place, tokens FROM g WHERE t <= 60""")
def chunk_from_relation(spark, sf):
    return L.chunks_from_relations(_edge_chunks(spark, sf), K.chunks(spark, sf), 60)


@query(_EDGE_CHUNKS + " SELECT edge_id, chunk_id FROM x WHERE place < 2 ORDER BY position, place, edge_id LIMIT 20")
def chunk_from_relations_capped(spark, sf):
    return L.capped_relation_chunks(_edge_chunks(spark, sf), 2, 20)


_SEEDS = "seeds AS (SELECT * FROM (VALUES ('part:1', 0), ('part:2', 1), ('part:9', 2)) v(entity_name, position))"
_TOGETHER = f"""co AS (SELECT a.entity_name AS src, b.entity_name AS tgt FROM mentioned a JOIN mentioned b ON a.chunk_id = b.chunk_id AND a.entity_name < b.entity_name GROUP BY ALL), near AS (SELECT src AS entity_name, tgt AS node FROM co UNION SELECT tgt, src FROM co)"""


@query(f"""WITH {K.SQL_PARTS}, {_SEEDS}, {_TOGETHER}, own AS (SELECT chunk_id, entity_name, position FROM mentioned JOIN seeds USING (entity_name)),
b AS (SELECT own.chunk_id, count(DISTINCT near.node) AS c FROM own JOIN near USING (entity_name) JOIN mentioned m ON m.chunk_id = own.chunk_id AND m.entity_name = near.node GROUP BY own.chunk_id)
SELECT chunk_id, min(position) AS position, coalesce(any_value(c), 0) AS relation_counts FROM own LEFT JOIN b USING (chunk_id) GROUP BY chunk_id ORDER BY position, relation_counts DESC, chunk_id LIMIT 30""")
def chunk_occurrence(spark, sf):
    from graphloom.operators import enrich as A

    m = K.chunk_parts(spark, sf)
    return L.occurrence(m, A.cooccurrence(m), names(spark, "part:1", "part:2", "part:9"), 30)


@query(f"WITH {K.SQL_PARTS} SELECT chunk_id, (count(*) * (count(*) - 1) / 2)::BIGINT AS pairs FROM mentioned WHERE entity_name IN (SELECT 'part:' || i FROM range(200) r(i)) GROUP BY chunk_id HAVING count(*) > 1 ORDER BY pairs DESC, chunk_id LIMIT 20")
def chunk_pair_occurrence(spark, sf):
    return L.pair_occurrence(K.chunk_parts(spark, sf), names(spark, *[f"part:{i}" for i in range(200)]), 20)


@query(f"""WITH {K.SQL_LINES}, {_SCORES}, r2c AS (SELECT DISTINCT src || '|' || tgt AS edge_id, chunk_id FROM lines WHERE relation = 'supplies'), e AS (SELECT DISTINCT src, tgt FROM lines WHERE relation = 'supplies'),
i AS (SELECT src AS entity_name, src || '|' || tgt AS edge_id FROM e UNION ALL SELECT tgt, src || '|' || tgt FROM e), r AS (SELECT edge_id, sum(score) AS s FROM i JOIN scores USING (entity_name) GROUP BY edge_id),
c AS (SELECT chunk_id, sum(s) AS s FROM r JOIN r2c USING (edge_id) GROUP BY chunk_id) SELECT chunk_id, round((s - (SELECT min(s) FROM c)) / ((SELECT max(s) FROM c) - (SELECT min(s) FROM c)), 6) AS score FROM c ORDER BY score DESC, chunk_id DESC LIMIT 20""")
def chunk_aggregate(spark, sf):
    e = K.trade_edges(spark, sf, sources=True).filter("relation = 'supplies'")
    return L.aggregate_chunks(_scores(spark, sf), e, K.chunks(spark, sf), 20)


@whole("o_orderkey < 300", old="7.0 / 300", new="7.0 / (SELECT count(*) FROM orders)")
@query("""WITH s AS (SELECT * FROM (VALUES ('supplies', 2.0::DOUBLE), ('bought', 1.0), ('urgent', 4.0)) v(edge_id, score)), c AS (SELECT 'order:' || o_orderkey AS chunk_id, CASE WHEN o_orderkey % 3 = 0 THEN ['supplies'] WHEN o_orderkey % 3 = 1 THEN ['bought', 'other'] ELSE ['none'] END AS ids, lower(o_orderpriority) AS text FROM orders WHERE o_orderkey < 300),
h AS (SELECT chunk_id, (SELECT sum(CASE WHEN list_contains(ids, edge_id) THEN score WHEN contains(text, edge_id) THEN 0.5 * score ELSE 0 END) FROM s) AS h FROM c) SELECT chunk_id, round(CASE WHEN h > 0 THEN h ELSE 7.0 / 300 END, 6) AS score FROM h ORDER BY score DESC, chunk_id LIMIT 200""")
def chunk_aggregate_by_edges(spark, sf, rows="o_orderkey < 300"):
    o = K.table(spark, sf, "orders").filter(rows)
    k = F.col("o_orderkey") % 3
    c = o.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("chunk_id"), F.when(k == 0, F.array(F.lit("supplies"))).when(k == 1, F.array(F.lit("bought"), F.lit("other"))).otherwise(F.array(F.lit("none"))).alias("edge_ids"), F.lower("o_orderpriority").alias("text"))
    return L.aggregate_by_edges(c, spark.createDataFrame([("supplies", 2.0), ("bought", 1.0), ("urgent", 4.0)], "edge_id string, score double"), 200)


@query(f"WITH {K.SQL_PARTS}, {K.SQL_CHUNKS}, o AS (SELECT entity_name, chunk_id FROM mentioned WHERE entity_name IN ('part:1', 'part:2', 'part:9') QUALIFY row_number() OVER (PARTITION BY entity_name ORDER BY chunk_id) <= 4) SELECT entity_name, chunk_id, content FROM o JOIN chunks USING (chunk_id)")
def chunk_texts_for_entities(spark, sf):
    return L.texts_for_entities(K.chunk_parts(spark, sf), K.chunks(spark, sf), names(spark, "part:1", "part:2", "part:9"), 4)


# communities: nations (level 1) inside regions (level 0)


def _membership(spark, sf):
    n = K.table(spark, sf, "nation")
    r, k = F.concat(F.lit("R"), F.col("n_regionkey").cast("string")), F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    own = None
    for t, key, nation in (("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey")):
        x = K.table(spark, sf, t).join(n, F.col(nation) == F.col("n_nationkey"))
        node = F.concat(F.lit(f"{t}:"), F.col(key).cast("string")).alias("node")
        x = x.select(node, F.lit(0).alias("level"), r.alias("cluster")).union(x.select(node, F.lit(1), k))
        own = x if own is None else own.union(x)
    return own


_MEMBERS = """x AS (SELECT 'customer:' || c_custkey AS node, n_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'supplier:' || s_suppkey, n_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
member AS (SELECT node, 0 AS level, 'R' || n_regionkey AS cluster FROM x UNION ALL SELECT node, 1, 'N' || n_nationkey FROM x)"""
_REPORTS = _MEMBERS + """, reports AS (SELECT cluster, level, count(*) / (SELECT count(*) FROM x)::DOUBLE AS occurrence, (count(*) % 7)::DOUBLE AS rating, 'report on ' || cluster || ' with ' || count(*) || ' members' AS report_string FROM member GROUP BY cluster, level)"""


def _reports(spark, sf):
    m = _membership(spark, sf)
    total = m.filter("level = 0").count()
    g = m.groupBy("cluster", "level").agg(F.count("*").alias("n"))
    return g.select("cluster", "level", (F.col("n") / total).alias("occurrence"), (F.col("n") % 7).cast("double").alias("rating"), F.concat(F.lit("report on "), "cluster", F.lit(" with "), F.col("n").cast("string"), F.lit(" members")).alias("report_string"))


@query(f"""WITH {K.SQL_PLACES}, {_MEMBERS}, nc AS (SELECT 'customer:' || o_custkey AS node, o_orderkey AS c FROM orders), b AS (SELECT level, cluster, count(*) AS n_nodes FROM member GROUP BY ALL),
e AS (SELECT level, cluster, count(DISTINCT src || '|' || tgt) AS n_edges FROM places JOIN member ON node = src OR node = tgt GROUP BY ALL), c AS (SELECT level, cluster, count(DISTINCT c) AS n_chunks FROM member JOIN nc USING (node) GROUP BY ALL),
s AS (SELECT 'R' || n_regionkey AS cluster, array_to_string(list_sort(list(DISTINCT 'N' || n_nationkey)), ',') AS subs FROM x GROUP BY 1)
SELECT level, cluster, n_nodes, coalesce(n_edges, 0) AS n_edges, coalesce(n_chunks, 0) AS n_chunks, round(coalesce(n_chunks, 0) / (SELECT max(n_chunks) FROM c), 6) AS occurrence, coalesce(subs, '') AS sub_communities FROM b LEFT JOIN e USING (level, cluster) LEFT JOIN c USING (level, cluster) LEFT JOIN s USING (cluster)""")
def community_schema(spark, sf):
    chunks = K.table(spark, sf, "orders").select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("entity_name"), F.col("o_orderkey").alias("chunk_id"))
    return CO.schema(_membership(spark, sf), K.place_edges(spark, sf), chunks)


_SOME = "('customer:1', 'customer:2', 'customer:3', 'customer:4', 'supplier:1', 'supplier:2')"


def _some(spark):
    return names(spark, "customer:1", "customer:2", "customer:3", "customer:4", "supplier:1", "supplier:2")


@query(f"""WITH {_REPORTS}, h AS (SELECT cluster, count(*) AS hits FROM member WHERE level <= 1 AND node IN {_SOME} GROUP BY cluster), o AS (SELECT cluster, hits, rating, 6::BIGINT AS tokens FROM h JOIN reports USING (cluster)),
s AS (SELECT *, sum(tokens) OVER (ORDER BY hits DESC, rating DESC, cluster ROWS UNBOUNDED PRECEDING) AS t FROM o) SELECT cluster, hits, rating, tokens FROM s WHERE t <= 40""")
def community_from_entity(spark, sf):
    return CO.from_entities(_membership(spark, sf), _some(spark), _reports(spark, sf), 1, 40)


@query(f"WITH {_REPORTS}, t AS (SELECT * FROM reports WHERE level <= 1 ORDER BY occurrence DESC, cluster LIMIT 12) SELECT cluster, level, round(occurrence, 9) AS occurrence, rating FROM t WHERE rating >= 2")
def community_from_level(spark, sf):
    return CO.from_level(_reports(spark, sf), 1, 12, 2.0).withColumn("occurrence", F.round("occurrence", 9))


@query(f"WITH {_REPORTS} SELECT cluster, count(DISTINCT node) AS overlap, round(any_value(occurrence), 9) AS occurrence FROM member JOIN reports USING (cluster) WHERE node IN {_SOME} GROUP BY cluster ORDER BY overlap DESC, occurrence DESC, cluster LIMIT 5")
def community_detect(spark, sf):
    return CO.detect(_membership(spark, sf), _some(spark), _reports(spark, sf), 5).withColumn("occurrence", F.round("occurrence", 9))


@query(f"WITH {_REPORTS} SELECT cluster, level, round(occurrence, 9) AS occurrence, row_number() OVER (ORDER BY level::VARCHAR, occurrence DESC, cluster) AS place FROM reports WHERE level <= 1")
def community_layer(spark, sf):
    return CO.layer(_reports(spark, sf), 1).withColumn("occurrence", F.round("occurrence", 9))


@query(f"""WITH {K.SQL_PLACES}, {_MEMBERS}, d AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM places UNION ALL SELECT tgt FROM places) GROUP BY node), m AS (SELECT DISTINCT node, cluster FROM member WHERE level = 1),
r AS (SELECT cluster, 'node' AS kind, node || ',' || node AS item, d AS rank FROM m JOIN d USING (node)), p AS (SELECT *, row_number() OVER w AS place, sum(len(string_split(item, ' '))) OVER (PARTITION BY cluster, kind ORDER BY rank DESC, item ROWS UNBOUNDED PRECEDING) AS t FROM r WINDOW w AS (PARTITION BY cluster, kind ORDER BY rank DESC, item))
SELECT cluster, kind, item, place FROM p WHERE t <= 5""")
def community_describe(spark, sf):
    nodes = K.nodes(spark, sf, ("supplier", "customer")).withColumn("description", F.col("entity_name"))
    return CO.describe(_membership(spark, sf).filter("level = 1"), nodes, K.place_edges(spark, sf), 10)


@query(f"""WITH {K.SQL_TRADE}, member AS (SELECT 'supplier:' || s_suppkey AS node, s_nationkey AS c FROM supplier UNION ALL SELECT 'customer:' || c_custkey, c_nationkey FROM customer UNION ALL SELECT 'part:' || p_partkey, p_size % 25 FROM part),
e AS (SELECT a.c AS a, b.c AS b, sum(weight) AS w FROM trade JOIN member a ON src = a.node JOIN member b ON tgt = b.node GROUP BY ALL), k AS (SELECT c, sum(w) AS k FROM (SELECT a AS c, w FROM e UNION ALL SELECT b, w FROM e) GROUP BY c), m AS (SELECT sum(k) AS m2 FROM k)
SELECT round(((SELECT 2 * sum(w) FROM e WHERE a = b) - (SELECT sum(k * k) FROM k) / m2) / m2, 9)::DOUBLE AS modularity, (SELECT count(*) FROM k) AS n_clusters FROM m""")
def community_modularity(spark, sf):
    s, c, p = (K.table(spark, sf, t) for t in ("supplier", "customer", "part"))
    member = s.select(F.concat(F.lit("supplier:"), "s_suppkey").alias("node"), F.col("s_nationkey").alias("cluster")).union(c.select(F.concat(F.lit("customer:"), "c_custkey"), "c_nationkey")).union(p.select(F.concat(F.lit("part:"), "p_partkey"), F.col("p_size") % 25))
    return LE.modularity(K.trade_edges(spark, sf), member)


_CONTEXT = """d AS (SELECT DISTINCT o_custkey AS q, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
raw AS (SELECT q, 1 AS t, -1 AS place, 'entity_name' || chr(9) || 'content' AS item FROM (SELECT DISTINCT q FROM d) UNION ALL SELECT q, 1, p, 'part:' || p || chr(9) || p_name FROM d JOIN part ON p = p_partkey
 UNION ALL SELECT q, 2, l.p, 'customer:' || q || chr(9) || 'part:' || l.p || chr(9) || 'bought ' || n FROM (SELECT o_custkey AS q, l_partkey AS p, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) l
 UNION ALL SELECT o_custkey, 3, o_orderkey, '[' || o_orderkey || ']  order of ' || o_orderpriority || chr(10) || '=====' || chr(10) || chr(10) FROM orders),
rows AS (SELECT q, t, place, item, row_number() OVER (PARTITION BY q, t ORDER BY place, item) AS i, length(item) + 1 AS size FROM raw),
b AS (SELECT c_custkey AS q, [60 + 10 * c_nationkey, 100 + c_custkey % 90, 5 * (c_custkey % 40)] AS b FROM customer)"""


@query(f"""WITH RECURSIVE {_CONTEXT},
st(q, b, step, i, rest, own, n) AS (SELECT q, b, 1, 1, 0, b[1], [0, 0, 0] FROM b UNION ALL
 SELECT x.q, x.b, CASE WHEN fit THEN step ELSE step + 1 END, CASE WHEN fit THEN i + 1 ELSE n[step % 3 + 1] + 1 END,
  CASE WHEN fit AND size <= rest THEN rest - size WHEN fit THEN rest ELSE rest + own END, CASE WHEN fit AND size <= rest THEN own WHEN fit THEN own - size WHEN step < 3 THEN b[step + 1] ELSE 0 END,
  CASE WHEN fit THEN [n[k] + (k = (step - 1) % 3 + 1)::INT FOR k IN [1, 2, 3]] ELSE n END
 FROM (SELECT st.*, r.size, coalesce(r.size <= st.rest OR r.size <= st.own, false) AS fit FROM st LEFT JOIN rows r ON r.q = st.q AND r.t = (st.step - 1) % 3 + 1 AND r.i = st.i WHERE st.step <= 6) x)
SELECT r.q::BIGINT AS question, ['entities', 'relationships', 'chunks'][t] AS "table", r.i AS n, r.item FROM rows r JOIN st ON st.q = r.q AND st.step = 7 AND r.i <= st.n[t]""")
def context_assembly(spark, sf):
    """For each customer as a question: parts, purchases and orders within three budgets."""
    c, p, o, l = (K.table(spark, sf, t) for t in ("customer", "part", "orders", "lineitem"))  # noqa: E741
    bought = o.join(l, o.o_orderkey == l.l_orderkey).groupBy(F.col("o_custkey").cast("long").alias("question"), "l_partkey").agg(F.count("*").alias("n"))
    header = bought.select("question", F.lit("entities").alias("table"), F.lit(-1).cast("long").alias("place"), CX.csv_row(F.lit("entity_name"), F.lit("content")).alias("item")).distinct()
    part = F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))
    entities = bought.join(p, F.col("l_partkey") == F.col("p_partkey")).select("question", F.lit("entities"), F.col("l_partkey").cast("long"), CX.csv_row(part, F.col("p_name")))
    edges = bought.select("question", F.lit("relationships"), F.col("l_partkey").cast("long"), CX.csv_row(F.concat(F.lit("customer:"), F.col("question").cast("string")), part, F.concat(F.lit("bought "), F.col("n").cast("string"))))
    chunks = o.select(F.col("o_custkey").cast("long"), F.lit("chunks"), F.col("o_orderkey").cast("long"), CX.reference_row(F.col("o_orderkey"), F.concat(F.lit("order of "), "o_orderpriority")))
    budgets = c.select(F.col("c_custkey").cast("long").alias("question"), (60 + 10 * F.col("c_nationkey")).alias("entities"), (100 + F.col("c_custkey") % 90).alias("relationships"), (5 * (F.col("c_custkey") % 40)).alias("chunks"))
    kept = CX.assemble(header.union(entities).union(edges).union(chunks), budgets)
    return kept.select("question", "table", F.row_number().over(W.partitionBy("question", "table").orderBy("place", "item")).cast("long").alias("n"), "item")


@query("""WITH h AS (SELECT o_custkey AS q, 0 AS side, o_orderkey AS place, o_orderpriority || ',' || o_orderstatus AS item FROM orders WHERE o_orderstatus = 'F'), l AS (SELECT o_custkey AS q, 1 AS side, o_orderkey AS place, o_orderpriority || ',' || o_orderstatus AS item FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0),
m AS (SELECT q, item, min(side * 1000000000000 + place) AS first FROM (SELECT * FROM h UNION ALL SELECT * FROM l) GROUP BY ALL), n AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY first, item) AS n, item FROM m)
SELECT q::BIGINT AS question, 'id,' || chr(9) || 'priority,' || chr(9) || 'status' || chr(10) || string_agg(n || ',' || chr(9) || item, chr(10) ORDER BY n) AS text FROM n GROUP BY q""")
def context_merge(spark, sf):
    o = K.table(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("question"), F.col("o_orderkey").alias("place"), F.concat_ws(",", "o_orderpriority", "o_orderstatus").alias("item"), "o_orderstatus")
    return CX.merged_text(CX.merge_contexts(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'F' or place % 2 = 0")), "id,priority,status")


@query()
def community_leiden(spark, sf):
    """Clusters of the places' graph in levels, none of over 100 nodes at the last."""
    return LE.hierarchical_leiden(K.place_edges(spark, sf), 100)


@query()
def community_reports(spark, sf):
    """Reports from nations up to regions over all suppliers, customers and their orders."""
    nodes = K.nodes(spark, sf, ("supplier", "customer", "nation", "region"))
    chunks = K.table(spark, sf, "orders").select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("entity_name"), F.col("o_orderkey").alias("chunk_id"))
    return RE.reports_by_level(_membership(spark, sf), nodes, K.place_edges(spark, sf), chunks, budget=200)


@query()
def community_cluster(spark, sf):
    return CO.cluster(K.place_edges(spark, sf), 100, 2)


@query("SELECT n_nationkey, '# ' || n_name || chr(10) || chr(10) || 'a nation' || chr(10) || chr(10) || '## size' || chr(10) || chr(10) || 'small' || chr(10) || chr(10) || '## place' || chr(10) || chr(10) || 'region ' || n_regionkey AS report FROM nation")
def community_report(spark, sf):
    n = K.table(spark, sf, "nation")
    f = lambda a, b: F.struct(F.lit(a).alias("summary"), b.alias("explanation"))
    found = F.array(f("size", F.lit("small")), f("place", F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))))
    return n.select("n_nationkey", CO.render_report(F.col("n_name"), F.lit("a nation"), found).alias("report"))


@query("""WITH n AS (SELECT c_custkey AS id, c_custkey % 6 AS k, lower(c_mktsegment) || ' ' || c_custkey AS s FROM customer),
t AS (SELECT id, CASE k WHEN 0 THEN 'what is the ' || s || '?' WHEN 1 THEN 'tell me about ' || s WHEN 2 THEN 'who was emperor ' || s || '?' WHEN 3 THEN 'what caused ' || s || '?' WHEN 4 THEN 'describe ' || s || 's' ELSE s || ' of the north' END AS q,
CASE k WHEN 0 THEN ['the ' || s, s, 'the ' || s || 's'] WHEN 1 THEN [s, s || 's', s || ' information', s || ' details'] WHEN 2 THEN ['emperor ' || s, s, 'emperor ' || s || ' biography', 'emperor ' || s || ' role']
WHEN 3 THEN [s, s || ' cause', s || ' reason', s || ' led to', s || ' resulted in'] WHEN 4 THEN [s || 's', s, s || 's information', s || 's details'] ELSE [] END AS more FROM n),
w AS (SELECT id, q, more, list_filter(string_split(q, ' '), lambda x: length(x) > 2 AND NOT list_contains(['the', 'what', 'who', 'was', 'how', 'for'], x)) AS words FROM t)
SELECT id, unnest(list_distinct(list_concat([q], more, words))) AS term FROM w""")
def query_expansion(spark, sf):
    k = F.col("c_custkey") % 6
    s = F.concat_ws(" ", "c_mktsegment", F.col("c_custkey").cast("string"))
    about = lambda before, after="": F.concat(F.lit(before), s, F.lit(after))
    q = F.when(k == 0, about("What is the ", "?")).when(k == 1, about("Tell me about ")).when(k == 2, about("Who was Emperor ", "?")).when(k == 3, about("What caused ", "?")).when(k == 4, about("Describe ", "s")).otherwise(about("", " of the north"))
    return K.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.explode(expand_query(q, titles=("emperor",))).alias("term"))
