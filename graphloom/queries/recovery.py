"""Names to nodes, broken answers to JSON, ontologies to one, and a graph built in batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.recovery import recovered
from graphloom.operators import merge as M
from graphloom.operators import ontology as ON
from graphloom.operators import resolution as RS
from graphloom.queries.registry import query
from graphloom.sources import commerce as K

_PARTS = """n AS (SELECT p_partkey, lower(p_name || ' ' || p_type || ' ' || replace(p_brand, '#', ' ')) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' lot ' || p_partkey % 50 END AS node FROM part),
asked AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN node WHEN 1 THEN upper(replace(node, ' ', '_')) WHEN 2 THEN '  ' || replace(node, ' ', '--') || '!' WHEN 3 THEN split_part(node, ' ', 2) || ' ' || split_part(node, ' ', 1)
 WHEN 4 THEN split_part(node, ' ', 1) || ' unheard ' || split_part(node, ' ', 3) || ' of' ELSE CASE WHEN p_partkey % 4 = 1 THEN 'chunk_' || p_partkey ELSE 'nobody knows' END END AS name FROM n)"""


@query(rf"""WITH {_PARTS}, nodes AS (SELECT DISTINCT node FROM n), c AS (SELECT name, trim(regexp_replace(lower(trim(name)), '[^a-z0-9 ]', ' ', 'g')) AS clean FROM asked), f AS (SELECT name, clean, trim(regexp_replace(clean, ' +', ' ', 'g')) AS compact FROM c),
d AS (SELECT name, compact, CASE WHEN regexp_matches(name, '(?i)^\s*chunk[_-][a-z0-9]+\s*$') THEN 'chunk' WHEN name IN (SELECT node FROM nodes) THEN 'exact' WHEN clean IN (SELECT node FROM nodes) THEN 'clean' WHEN compact NOT LIKE 'chunk %' AND compact IN (SELECT node FROM nodes) THEN 'compact' END AS how,
 CASE WHEN name IN (SELECT node FROM nodes) THEN name WHEN clean IN (SELECT node FROM nodes) THEN clean ELSE compact END AS node FROM f),
q AS (SELECT name, unnest(list_distinct(string_split(compact, ' '))) AS token FROM d WHERE how IS NULL AND compact <> '' AND compact || ' ' NOT LIKE 'chunk %'), qn AS (SELECT name, count(*) AS n FROM q GROUP BY name),
t AS (SELECT node, unnest(list_distinct(string_split(node, ' '))) AS token FROM nodes), tn AS (SELECT node, count(*) AS m FROM t GROUP BY node), s AS (SELECT name, node, count(*) AS shared FROM q JOIN t USING (token) GROUP BY ALL),
b AS (SELECT name, node, shared, n FROM s JOIN qn USING (name) JOIN tn USING (node) QUALIFY row_number() OVER (PARTITION BY name ORDER BY shared DESC, m, length(node), node) = 1)
SELECT d.name, CASE WHEN d.how IN ('exact', 'clean', 'compact') THEN d.node WHEN d.how IS NULL THEN b.node END AS entity_name, coalesce(d.how, CASE WHEN b.shared = b.n THEN 'subset' WHEN b.shared > 0 THEN 'partial' END, 'none') AS how FROM d LEFT JOIN b ON b.name = d.name""")
def resolve_ids_cascade(spark, sf):
    """Names made from all parts' names, right and wrong, to the node each means."""
    p = K.table(spark, sf, "part")
    k = F.col("p_partkey")
    node = F.concat(F.lower(F.concat_ws(" ", "p_name", "p_type", F.replace("p_brand", F.lit("#"), F.lit(" ")))), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit(" lot "), (k % 50).cast("string"))))
    n = p.select(k, node.alias("node"))
    part = lambda i: F.split("node", " ")[i - 1]
    name = (
        F.when(k % 6 == 0, F.col("node")).when(k % 6 == 1, F.upper(F.replace("node", F.lit(" "), F.lit("_")))).when(k % 6 == 2, F.concat(F.lit("  "), F.replace("node", F.lit(" "), F.lit("--")), F.lit("!")))
        .when(k % 6 == 3, F.concat_ws(" ", part(2), part(1))).when(k % 6 == 4, F.concat_ws(" ", part(1), F.lit("unheard"), part(3), F.lit("of"))).when(k % 4 == 1, F.concat(F.lit("chunk_"), k.cast("string"))).otherwise("nobody knows"))
    return RS.resolve_ids(n.select(F.col("node").alias("entity_name")), n.select(name.alias("name")))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '{"kind": "' || c_mktsegment || '", "n": ' || c_nationkey || '}' WHEN 1 THEN '{"list": [1, {"x": "' || c_name || '"}]}'
 WHEN 2 THEN '{"kind": "' || c_mktsegment || '", "n": ' || c_nationkey || ', "ok": true}' WHEN 3 THEN '{"name": "a } in ' || c_name || '"}' WHEN 4 THEN '[' || c_nationkey || ', 2]' ELSE '{}' END AS found FROM customer""")
def json_recovery_texts(spark, sf):
    """Answers of six makes for all customers: fenced, within prose, cut off, after a bracket that closes nothing, an array, and none."""
    c, n, k = F.col("c_mktsegment"), F.col("c_nationkey").cast("string"), F.col("c_custkey") % 6
    said = (
        F.when(k == 0, F.concat(F.lit('```json\n{"n": '), n, F.lit(', "kind": "'), c, F.lit('"}\n```')))
        .when(k == 1, F.concat(F.lit('Sure, here: {"list": [1, {"x": "'), F.col("c_name"), F.lit('"}]} and {"later": 2}')))
        .when(k == 2, F.concat(F.lit('{"kind": "'), c, F.lit('", "n": '), n, F.lit(', "ok": true')))
        .when(k == 3, F.concat(F.lit('} oops ] {"name": "a } in '), F.col("c_name"), F.lit('"} {')))
        .when(k == 4, F.concat(F.lit("the list is ["), n, F.lit(", 2] as asked"))).otherwise("nothing here"))
    return K.table(spark, sf, "customer").select("c_custkey", recovered(said).alias("found"))


_VIEWS = """v AS (SELECT c_nationkey, c_mktsegment AS view, min(c_custkey) AS place, list_sort(list(DISTINCT CASE c_custkey % 5 WHEN 0 THEN 'User' WHEN 1 THEN 'Post' ELSE 'Kind' || c_custkey % 5 END)) AS entities, list_sort(list(DISTINCT 'p' || c_custkey % 4)) AS props FROM customer GROUP BY ALL)"""


@query(f"""WITH {_VIEWS}, e AS (SELECT c_nationkey, view, place, props, unnest(entities) AS name FROM v), f AS (SELECT c_nationkey, name, arg_min(name || ' in the context of ' || view, place) AS description, arg_min(props[1], place) AS key_property, count(*) AS n_views, min(place) AS place FROM e GROUP BY ALL),
p AS (SELECT c_nationkey, name, string_agg(DISTINCT prop, ',' ORDER BY prop) AS properties FROM (SELECT c_nationkey, name, unnest(props) AS prop FROM e) GROUP BY ALL)
SELECT c_nationkey, name, description, key_property, properties, n_views, n_views > 1 AS shared FROM f JOIN p USING (c_nationkey, name)""")
def ontology_entities(spark, sf):
    return ON.unify_entities(_views(spark, sf), ["c_nationkey"]).select("c_nationkey", "name", "description", "key_property", F.array_join(F.array_sort(F.map_keys("properties")), ",").alias("properties"), "n_views", "shared")


@query(f"""WITH {_VIEWS}, r AS (SELECT c_nationkey, place, 'has ' || entities[1] AS name, 'has ' || entities[1] || ' relationship for ' || view AS description, entities[1] AS domain, coalesce(entities[2], entities[1]) AS "range" FROM v)
SELECT c_nationkey, name, arg_min(description, place) AS description, arg_min(domain, place) AS domain, arg_min("range", place) AS "range" FROM r GROUP BY c_nationkey, name""")
def ontology_relationships(spark, sf):
    return ON.unify_relationships(_views(spark, sf), ["c_nationkey"]).select("c_nationkey", "name", "description", "domain", "range")


def _views(spark, sf):
    c = K.table(spark, sf, "customer")
    kind = F.when(F.col("c_custkey") % 5 == 0, "User").when(F.col("c_custkey") % 5 == 1, "Post").otherwise(F.concat(F.lit("Kind"), (F.col("c_custkey") % 5).cast("string")))
    prop = F.concat(F.lit("p"), (F.col("c_custkey") % 4).cast("string"))
    v = c.groupBy("c_nationkey", F.col("c_mktsegment").alias("view")).agg(F.min("c_custkey").alias("place"), F.array_sort(F.collect_set(kind)).alias("kinds"), F.array_sort(F.collect_set(prop)).alias("props"))
    links = F.array(F.concat(F.lit("has "), F.col("kinds")[0]))
    return v.withColumns(ON.mini_ontology(F.col("kinds"), F.col("props"), links, F.col("view")))


@query("""WITH l AS (SELECT least('supplier:' || l_suppkey, 'part:' || l_partkey) AS src, greatest('supplier:' || l_suppkey, 'part:' || l_partkey) AS tgt, l_orderkey AS source_id, 'ships ' || l_linenumber AS description FROM lineitem)
SELECT src, tgt, count(*)::DOUBLE AS weight, count(DISTINCT source_id) AS n_sources, md5(string_agg(DISTINCT description, '<SEP>' ORDER BY description)) AS descriptions FROM l GROUP BY ALL""")
def upsert_edges_by_halves(spark, sf):
    """Edges of all order lines: merged from the odd orders, then the even ones put in."""
    l = K.table(spark, sf, "lineitem")  # noqa: E741
    mentions = l.select(
        F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("src_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("tgt_id"), F.lit("").alias("relation_name"),
        F.concat(F.lit("ships "), F.col("l_linenumber").cast("string")).alias("description"), F.lit("").alias("keywords"), F.lit(1.0).alias("weight"), F.col("l_orderkey").alias("source_id"))
    out = M.upsert_edges(M.merge_edges(mentions.filter("source_id % 2 = 1")), mentions.filter("source_id % 2 = 0"))
    return out.select("src", "tgt", "weight", F.size("source_ids").cast("long").alias("n_sources"), F.md5("description").alias("descriptions"))
