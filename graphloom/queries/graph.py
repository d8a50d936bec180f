"""Graph primitives, traversal, propagation and analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.queries.registry import query
from graphloom.sources import commerce as K


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


@query(f"WITH {K.SQL_EDGES} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT tgt FROM edges) GROUP BY node")
def node_degree(spark, sf):
    return G.degree(K.edges(spark, sf))


@query(f"""WITH {K.SQL_PLACES}, d AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM places UNION ALL SELECT tgt FROM places) GROUP BY node)
SELECT src, tgt, relation, weight, a.n + b.n AS rank FROM places JOIN d a ON src = a.node JOIN d b ON tgt = b.node""")
def edge_degree(spark, sf):
    return G.edge_degree(K.place_edges(spark, sf))


@query(f"""WITH {K.SQL_EDGES} SELECT src, tgt, relation, weight FROM edges WHERE src IN ('supplier:1', 'nation:3') OR tgt IN ('supplier:1', 'nation:3')""")
def incident_edges(spark, sf):
    return G.incident(K.edges(spark, sf), seeds(spark, "supplier:1", "nation:3"))


@query(f"""WITH {K.SQL_EDGES} SELECT DISTINCT seed, node FROM (SELECT src AS seed, tgt AS node FROM edges UNION ALL SELECT tgt, src FROM edges) WHERE seed IN ('supplier:2', 'part:7', 'region:1')""")
def neighbours_of(spark, sf):
    return G.neighbours(K.edges(spark, sf), seeds(spark, "supplier:2", "part:7", "region:1"))


@query(f"""WITH {K.SQL_EDGES} SELECT src, tgt, relation, weight FROM edges WHERE (src, tgt) IN (('part:1', 'supplier:1'), ('customer:5', 'nation:' || (SELECT c_nationkey FROM customer WHERE c_custkey = 5)), ('nation:0', 'region:0'))""")
def edge_lookup(spark, sf):
    nation = K.table(spark, sf, "customer").filter("c_custkey = 5").select(F.lit("customer:5").alias("tgt"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("src"))
    pairs = spark.createDataFrame([("supplier:1", "part:1"), ("region:0", "nation:0")], "src string, tgt string").unionByName(nation)
    return G.get_edges(K.edges(spark, sf), pairs)


@query(f"""WITH {K.SQL_PLACES} SELECT src, tgt, relation, weight FROM places WHERE (src LIKE 'nation:%' OR src LIKE 'region:%' OR src IN ('customer:1', 'supplier:1')) AND (tgt LIKE 'nation:%' OR tgt LIKE 'region:%' OR tgt IN ('customer:1', 'supplier:1'))""")
def induced_subgraph(spark, sf):
    names = K.nodes(spark, sf, ("nation", "region")).select(F.col("entity_name").alias("node")).union(seeds(spark, "customer:1", "supplier:1"))
    return G.induced(K.place_edges(spark, sf), names)


_HOPS = f"""WITH RECURSIVE {K.SQL_PLACES}, adj AS (SELECT src, tgt FROM places UNION SELECT tgt, src FROM places),
h1 AS (SELECT DISTINCT tgt AS node FROM adj WHERE src = 'supplier:1' AND tgt <> 'supplier:1'),
h2 AS (SELECT DISTINCT tgt AS node FROM adj JOIN h1 ON src = node WHERE tgt <> 'supplier:1' AND tgt NOT IN (SELECT node FROM h1))"""


@query(_HOPS + " SELECT node, 2 AS hop FROM h2")
def khop_frontier(spark, sf):
    return G.khop(K.place_edges(spark, sf), seeds(spark, "supplier:1"), 2)


@query(_HOPS + " SELECT 'supplier:1' AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2")
def khop_cumulative(spark, sf):
    return G.khop(K.place_edges(spark, sf), seeds(spark, "supplier:1"), 2, "cumulative")


@query(f"""WITH {K.SQL_PLACES}, s AS (SELECT src, tgt, relation, weight FROM places WHERE src = 'nation:3' OR tgt = 'nation:3') SELECT * FROM s""")
def expand_enough_direct(spark, sf):
    """A nation's own edges are more than five, so they aren't widened."""
    return G.expand_until(K.place_edges(spark, sf), seeds(spark, "nation:3"), 1000, 3, enough=5)


@query(f"""WITH RECURSIVE {K.SQL_PLACES}, adj AS (SELECT src, tgt FROM places UNION SELECT tgt, src FROM places),
p(start, path, here, hops) AS (SELECT src, [src], src, 0 FROM (SELECT DISTINCT src FROM adj WHERE src LIKE 'region:%' OR src = 'supplier:1') UNION ALL SELECT start, list_append(path, tgt), tgt, hops + 1 FROM p JOIN adj ON src = here WHERE hops < 3 AND NOT list_contains(path, tgt))
SELECT start, here AS target, hops::BIGINT AS hops, array_to_string(path, '>') AS path FROM p WHERE hops > 0 QUALIFY row_number() OVER (PARTITION BY start, here ORDER BY hops, path) <= 2""")
def ego_paths_k3(spark, sf):
    starts = K.nodes(spark, sf, ("region",)).select(F.col("entity_name").alias("node")).union(seeds(spark, "supplier:1"))
    return G.ego_paths(K.place_edges(spark, sf), starts, 3, most=None).withColumn("path", F.concat_ws(">", "path"))


@query(f"""WITH RECURSIVE {K.SQL_PLACES}, adj AS (SELECT src, tgt FROM places UNION SELECT tgt, src FROM places),
p(path, here, hops) AS (SELECT ['supplier:1'], 'supplier:1', 0 UNION ALL SELECT list_append(path, tgt), tgt, hops + 1 FROM p JOIN adj ON src = here WHERE hops < 4 AND NOT list_contains(path, tgt))
SELECT array_to_string(path, '>') AS path, hops::BIGINT AS hops FROM p WHERE hops > 0 AND here LIKE 'region:%'""")
def simple_paths_k4(spark, sf):
    out = G.simple_paths(K.place_edges(spark, sf), seeds(spark, "supplier:1"), K.nodes(spark, sf, ("region",)).select(F.col("entity_name").alias("node")), 4)
    return out.select(F.concat_ws(">", "path").alias("path"), "hops")


@query(f"""WITH RECURSIVE {K.SQL_PLACES}, adj AS (SELECT src, tgt FROM places UNION SELECT tgt, src FROM places),
p(seed, path, here, hops) AS (SELECT s, [s], s, 0 FROM (VALUES ('supplier:1'), ('customer:9')) v(s) UNION ALL SELECT seed, list_append(path, tgt), tgt, hops + 1 FROM p JOIN adj ON src = here WHERE hops < 6 AND NOT list_contains(path, tgt) AND (tgt NOT LIKE 'customer:%' AND tgt NOT LIKE 'supplier:%' OR tgt IN ('supplier:4', 'customer:8'))),
b AS (SELECT seed, here AS node, hops, path, row_number() OVER (PARTITION BY seed, here ORDER BY hops, path) AS r FROM p WHERE here IN ('supplier:4', 'customer:8') AND hops > 0)
SELECT seed, node, hops::BIGINT AS hops, array_to_string(path, '>') AS path FROM b WHERE r = 1""")
def shortest_path_pairs(spark, sf):
    out = G.shortest_paths(K.place_edges(spark, sf), seeds(spark, "supplier:1", "customer:9"), seeds(spark, "supplier:4", "customer:8"), 6)
    return out.select("seed", "node", "hops", F.concat_ws(">", "path").alias("path"))


def _nation_pairs(spark, sf):
    """Nations tied by orders of one of their customers from one of their suppliers worth over 100,000: a filtered graph with several components."""
    c = K.table(spark, sf, "customer").filter("c_acctbal > 4000").select("c_custkey", "c_nationkey")
    s = K.table(spark, sf, "supplier").filter("s_acctbal > 4000").select("s_suppkey", "s_nationkey")
    big = K.table(spark, sf, "lineitem").filter("l_extendedprice > 104000").select("l_orderkey", "l_suppkey")
    o = K.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    x = big.join(o, big.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, F.col("l_suppkey") == s.s_suppkey)
    a, b = F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")), F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string"))
    return x.select(a.alias("src"), b.alias("tgt")).distinct()


_PAIRS = """deals AS (SELECT DISTINCT 'customer:' || c_custkey AS src, 'supplier:' || s_suppkey AS tgt FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
 WHERE l_extendedprice > 104000 AND c_acctbal > 4000 AND s_acctbal > 4000)"""
_COMPONENTS = f"""WITH RECURSIVE {_PAIRS}, adj AS (SELECT src, tgt FROM deals UNION SELECT tgt, src FROM deals),
reach(node, other) AS (SELECT src, src FROM adj UNION SELECT r.node, a.tgt FROM reach r JOIN adj a ON r.other = a.src), comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""


@query(_COMPONENTS + " SELECT node, component FROM comp")
def connected_components(spark, sf):
    return G.connected_components(_nation_pairs(spark, sf))


@query(_COMPONENTS + """, t AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT node, upper(node) AS name FROM comp SEMI JOIN t USING (component)""")
def largest_component(spark, sf):
    return G.largest_component(_nation_pairs(spark, sf))


@query(_COMPONENTS + """, e AS (SELECT component, count(*) AS n_edges FROM deals JOIN comp ON src = node GROUP BY component),
n AS (SELECT component, count(*) AS n_nodes, array_to_string(list_sort(list(node))[1:3], ',') AS sample FROM comp GROUP BY component)
SELECT component, n_nodes, n_edges, round(2 * n_edges / (n_nodes * (n_nodes - 1)), 9) AS density, sample FROM n JOIN e USING (component) ORDER BY n_nodes DESC, component LIMIT 10""")
def component_details(spark, sf):
    return G.component_details(_nation_pairs(spark, sf))


@query("""WITH RECURSIVE d AS (SELECT DISTINCT o_custkey % 60 AS a, (o_custkey * 7 + o_orderkey) % 60 AS b FROM orders WHERE o_totalprice > 480000), e AS (SELECT a::VARCHAR AS src, b::VARCHAR AS tgt FROM d WHERE a <> b),
reach(x, y) AS (SELECT src, src FROM e UNION SELECT tgt, tgt FROM e UNION SELECT r.x, e.tgt FROM reach r JOIN e ON r.y = e.src)
SELECT p.x AS node, min(p.y) AS component FROM reach p JOIN reach q ON p.x = q.y AND p.y = q.x GROUP BY p.x""")
def strong_components(spark, sf):
    o = K.table(spark, sf, "orders").filter("o_totalprice > 480000")
    e = o.select((F.col("o_custkey") % 60).cast("string").alias("src"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 60).cast("string").alias("tgt")).filter("src <> tgt").distinct()
    return G.strong_components(e)


def _power(reset: str, damping: float, iterations: int) -> str:
    out = f"""WITH {K.SQL_PLACES}, adj AS (SELECT src, tgt, weight FROM places UNION ALL SELECT tgt, src, weight FROM places),
p AS (SELECT src, tgt, weight / sum(weight) OVER (PARTITION BY src) AS p FROM adj), nodes AS (SELECT DISTINCT src AS node FROM adj), base AS ({reset}), r0 AS (SELECT node, jump AS score FROM base)"""
    for i in range(iterations):
        out += f""", r{i + 1} AS MATERIALIZED (SELECT base.node, {1 - damping} * jump + {damping} * coalesce(got, 0) AS score FROM base LEFT JOIN (SELECT tgt AS node, sum(score * p) AS got FROM p JOIN r{i} ON src = node GROUP BY tgt) g ON base.node = g.node)"""
    return out + f" SELECT node, round(score, 6) AS score FROM r{iterations}"


@query(_power("SELECT node, 1.0 / (SELECT count(*) FROM nodes) AS jump FROM nodes", 0.85, 10))
def pagerank_fixed(spark, sf):
    return G.pagerank(K.place_edges(spark, sf), 10).select("node", F.round("score", 6).alias("score"))


@query(_power("SELECT node, CASE WHEN node IN ('supplier:1', 'nation:4') THEN 0.5 ELSE 0.0 END AS jump FROM nodes", 0.85, 10))
def ppr_fixed(spark, sf):
    reset = spark.createDataFrame([("supplier:1", 1.0), ("nation:4", 1.0), ("unknown:1", 3.0)], "node string, share double")
    return G.pagerank(K.place_edges(spark, sf), 10, 0.85, reset).select("node", F.round("score", 6).alias("score"))


@query(f"""WITH {K.SQL_PLACES}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM places UNION ALL SELECT tgt FROM places) GROUP BY node)
SELECT node, degree, round(degree / ((SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) - 1), 9) AS centrality FROM d ORDER BY degree DESC, node LIMIT 20""")
def degree_centrality_topk(spark, sf):
    return G.degree_centrality(K.nodes(spark, sf, ("supplier", "customer", "nation", "region")), K.place_edges(spark, sf), 20)


@query(f"""WITH {K.SQL_EDGES}, n AS (SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM part) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n), m AS (SELECT count(*) AS m, count(*) FILTER (src = tgt) AS self_loops FROM edges)
SELECT n, m, self_loops, round(2 * m / (n * (n - 1)), 9) AS density, round(2 * m / n, 6) AS average_degree FROM n, m""")
def graph_basic_stats(spark, sf):
    return G.basic_stats(K.nodes(spark, sf), K.edges(spark, sf))


_TOGETHER = """mentioned AS (SELECT DISTINCT l_orderkey AS o, 'part:' || l_partkey AS p FROM lineitem),
together AS (SELECT DISTINCT a.p AS src, b.p AS tgt FROM mentioned a JOIN mentioned b ON a.o = b.o AND a.p < b.p)"""


def _together(spark, sf):
    """Pairs of parts of one order, as numbers; a pair comes once an order."""
    lines = K.table(spark, sf, "lineitem").filter("l_orderkey is not null")
    parts = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts"))
    first = parts.select("parts", F.posexplode("parts").alias("at", "src"))
    return first.select("src", F.explode(F.expr("slice(parts, at + 2, size(parts))")).alias("tgt"))


def _part(number):
    return F.concat(F.lit("part:"), number.cast("string"))


@query(f"""WITH {_TOGETHER} SELECT x.src AS a, x.tgt AS b, y.tgt AS c FROM together x JOIN together y ON x.tgt = y.src JOIN together z ON z.src = x.src AND z.tgt = y.tgt""")
def triangle_list(spark, sf):
    return G.triangles(_together(spark, sf), _part)


@query(f"""WITH {_TOGETHER}, t AS (SELECT x.src AS a, x.tgt AS b, y.tgt AS c FROM together x JOIN together y ON x.tgt = y.src JOIN together z ON z.src = x.src AND z.tgt = y.tgt),
per AS (SELECT node, count(*) AS t FROM (SELECT unnest([a, b, c]) AS node FROM t) GROUP BY node), d AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM together UNION ALL SELECT tgt FROM together) GROUP BY node),
b AS (SELECT coalesce(t, 0) AS t, d * (d - 1) / 2 AS w FROM d LEFT JOIN per USING (node))
SELECT (sum(t) / 3)::BIGINT AS triangles, round(sum(t) / sum(w), 6) AS transitivity, round(avg(CASE WHEN w > 0 THEN t / w ELSE 0 END), 6) AS average_clustering FROM b""")
def triangles_transitivity(spark, sf):
    return G.clustering(_together(spark, sf))


_SMALL = """small AS (SELECT least('nation:' || n_nationkey, 'region:' || n_regionkey) AS src, greatest('nation:' || n_nationkey, 'region:' || n_regionkey) AS tgt FROM nation
 UNION ALL SELECT 'region:' || r_regionkey, 'region:' || (r_regionkey + 1) FROM region WHERE r_regionkey < 4), adj AS (SELECT src, tgt FROM small UNION SELECT tgt, src FROM small)"""
_DIST = f"""WITH RECURSIVE {_SMALL}, r(seed, node, hops) AS (SELECT DISTINCT src, src, 0 FROM adj UNION SELECT r.seed, tgt, hops + 1 FROM r JOIN adj ON src = node WHERE hops < 8),
d AS (SELECT seed, node, min(hops) AS hops FROM r GROUP BY ALL)"""


def _small(spark, sf):
    """Nations in regions, and the regions in a row: a tree of 30 nodes."""
    n = K.place_edges(spark, sf).filter("relation = 'in_region'").select("src", "tgt")
    r = K.table(spark, sf, "region").filter("r_regionkey < 4")
    return n.union(r.select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")), F.concat(F.lit("region:"), (F.col("r_regionkey") + 1).cast("string"))))


@query(_DIST + """, e AS (SELECT seed, max(hops) AS e, sum(hops) AS s, count(*) AS n FROM d WHERE seed <> node GROUP BY seed) SELECT max(e)::BIGINT AS diameter, min(e)::BIGINT AS radius, round(sum(s) / sum(n), 6) AS average_path FROM e""")
def path_metrics_small(spark, sf):
    return G.path_metrics(_small(spark, sf))


@query(_DIST + """ SELECT seed AS node, round(count(*) / sum(hops) * count(*) / ((SELECT count(DISTINCT src) FROM adj) - 1), 9) AS closeness FROM d WHERE seed <> node AND seed LIKE 'region:%' GROUP BY seed""")
def closeness_regions(spark, sf):
    return G.closeness(_small(spark, sf), K.nodes(spark, sf, ("region",)).select(F.col("entity_name").alias("node")))


@query(_DIST + """, n AS (SELECT count(DISTINCT src) AS n FROM adj), v AS (SELECT DISTINCT src AS v FROM adj)
SELECT v AS node, round((SELECT count(*) FROM d st JOIN d sv ON sv.seed = st.seed AND sv.node = v JOIN d vt ON vt.seed = v AND vt.node = st.node WHERE st.seed <> v AND st.node <> v AND st.seed <> st.node AND sv.hops + vt.hops = st.hops) / ((n - 1) * (n - 2)), 9) AS betweenness FROM v, n""")
def betweenness_small(spark, sf):
    return G.betweenness(_small(spark, sf))


_EIGEN = f"WITH {_SMALL}, x0 AS (SELECT DISTINCT src AS node, 1.0::DOUBLE AS v FROM adj)" + "".join(
    f", y{i} AS (SELECT x.node, any_value(x.v) + sum(z.v) AS v FROM x{i} x JOIN adj ON adj.tgt = x.node JOIN x{i} z ON z.node = adj.src GROUP BY x.node), x{i + 1} AS MATERIALIZED (SELECT node, v / (SELECT sqrt(sum(v * v)) FROM y{i}) AS v FROM y{i})" for i in range(8))


@query(_EIGEN + " SELECT node, round(v, 6) AS eigenvector FROM x8")
def eigenvector_small(spark, sf):
    return G.eigenvector(_small(spark, sf), 8)


@query(f"""WITH {K.SQL_NODES} SELECT entity_name, entity_type, description, concat_ws(': ', entity_name, entity_type, nullif(trim(description), '')) AS content FROM nodes""")
def node_content(spark, sf):
    return G.node_texts(K.nodes(spark, sf))


@query(f"""WITH {K.SQL_LINES} SELECT chunk_id, array_to_string(list_sort(list_distinct(list(src || ' ' || relation || ' ' || tgt))), '; ') AS content FROM lines GROUP BY chunk_id""")
def subgraph_documents(spark, sf):
    return G.subgraph_documents(K.trade_lines(spark, sf))


@query()
def steiner_tree_places(spark, sf):
    return G.steiner_tree(K.place_edges(spark, sf), seeds(spark, "supplier:1", "supplier:2", "customer:3", "region:0"))


@query()
def greedy_chain(spark, sf):
    out = G.chain_seeds(_small(spark, sf), seeds(spark, "nation:1", "nation:2", "nation:9", "region:4"), 8)
    return out.select("step", "seed", "node", F.concat_ws(">", "path").alias("path"))


@query(f"""WITH {K.SQL_PLACES}, a AS (SELECT src, tgt, relation, weight FROM places WHERE src = 'region:2' OR tgt = 'region:2'), s AS (SELECT src AS node FROM a UNION SELECT tgt FROM a),
b AS (SELECT DISTINCT src, tgt, relation, weight FROM places WHERE src IN (SELECT node FROM s) OR tgt IN (SELECT node FROM s))
SELECT * FROM a WHERE (SELECT count(*) FROM a) > 10 UNION ALL SELECT * FROM b WHERE (SELECT count(*) FROM a) <= 10""")
def expand_until_many(spark, sf):
    return G.expand_until(K.place_edges(spark, sf), seeds(spark, "region:2"), 10, 1)
