"""Cross-modal conversions and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.alignment import alignment_scores
from graphloom.operators import crossmodal as X
from graphloom.operators import evaluate as V
from graphloom.queries.registry import query, whole
from graphloom.sources import commerce as K

_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


@query(f"WITH {K.SQL_NODES} SELECT entity_name AS id, entity_name AS label, entity_type AS type, description FROM nodes")
def modality_nodes_table(spark, sf):
    return X.nodes_table(K.nodes(spark, sf))


@query(f"WITH {K.SQL_PLACES} SELECT src AS source, tgt AS target, relation AS type, weight FROM places")
def modality_edges_table(spark, sf):
    return X.edges_table(K.place_edges(spark, sf))


@query(f"WITH {K.SQL_PLACES} SELECT src AS row, tgt AS col, weight FROM places WHERE relation = 'in_region' UNION ALL SELECT tgt, src, weight FROM places WHERE relation = 'in_region'")
def modality_adjacency_long(spark, sf):
    return X.adjacency_long(K.place_edges(spark, sf).filter("relation = 'in_region'"))


@query("SELECT c_name AS src, c_mktsegment AS tgt, 'related_to' AS relation, 1.0::DOUBLE AS weight FROM customer")
def modality_table_to_edges(spark, sf):
    return X.convert(K.table(spark, sf, "customer"), "table", "graph", "entity_rel")


@query(f"WITH {K.SQL_PLACES} SELECT src, tgt, weight FROM places WHERE relation = 'in_region'")
def modality_matrix_to_edges(spark, sf):
    return X.matrix_to_edges(X.adjacency_wide(K.place_edges(spark, sf).filter("relation = 'in_region'")))


@query(f"WITH {K.SQL_NODES} SELECT entity_name AS id, entity_name || ' | ' || entity_type || ' | description: ' || description AS text FROM nodes")
def modality_node_sentences(spark, sf):
    return X.node_sentences(K.nodes(spark, sf))


@query("SELECT 's_suppkey: ' || s_suppkey || ' | s_name: ' || s_name || ' | s_nationkey: ' || s_nationkey AS text FROM supplier")
def modality_row_sentences(spark, sf):
    return X.row_sentences(K.table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"))


@query(f"""WITH {K.SQL_EDGES}, {K.SQL_NODES}, d AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM edges UNION ALL SELECT tgt FROM edges) GROUP BY node), n AS (SELECT count(*) AS n, count(DISTINCT entity_type) AS node_types FROM nodes),
e AS (SELECT count(*) AS m, count(DISTINCT relation) AS edge_types, round(avg(weight), 6) AS weight_mean, round(stddev_pop(weight), 6) AS weight_std FROM edges)
SELECT n, m, round(m / n, 6) AS edges_per_node, (SELECT round(avg(d), 6) FROM d) AS degree_mean, (SELECT round(stddev_pop(d), 6) FROM d) AS degree_std, (SELECT max(d) FROM d) AS degree_max, node_types, edge_types, weight_mean, weight_std FROM n, e""")
def modality_graph_features(spark, sf):
    return X.graph_features(K.nodes(spark, sf), K.edges(spark, sf))


@query("""WITH v AS (SELECT c_custkey::DOUBLE AS v FROM customer UNION ALL SELECT c_nationkey FROM customer UNION ALL SELECT c_acctbal FROM customer)
SELECT (SELECT count(*) FROM customer) AS n_rows, 5::BIGINT AS n_columns, 0::BIGINT AS n_nulls, 3::BIGINT AS n_numeric, 2::BIGINT AS n_text, round(avg(v), 4) AS value_mean, round(stddev_pop(v), 2) AS value_std, min(v) AS value_min, max(v) AS value_max,
(SELECT round((count(DISTINCT c_custkey) + count(DISTINCT c_name) + count(DISTINCT c_nationkey) + count(DISTINCT c_acctbal) + count(DISTINCT c_mktsegment)) / 5, 4) FROM customer) AS mean_distinct, 0::BIGINT AS duplicate_rows FROM v""")
def modality_table_stats(spark, sf):
    return X.table_stats(K.table(spark, sf, "customer"))


@query("""SELECT vec_id, len(embedding)::BIGINT AS dims, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_sum(embedding::DOUBLE[]) / len(embedding), 6) AS mean,
round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / len(embedding) - pow(list_sum(embedding::DOUBLE[]) / len(embedding), 2)), 6) AS std FROM embeddings""")
def modality_vector_direct(spark, sf):
    return X.vectors_table(K.table(spark, sf, "embeddings"))


@query(f"SELECT a.vec_id AS src, b.vec_id AS tgt, round({_COS}, 6) AS weight, 'similar_to' AS relation FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round({_COS}, 6) >= 0.3")
def modality_similarity_graph(spark, sf):
    return X.similarity_graph(K.table(spark, sf, "embeddings"), 0.3)


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, CASE WHEN a.vec_id = b.vec_id THEN 1.0 ELSE round({_COS}, 6) END AS score FROM embeddings a, embeddings b")
def modality_similarity_table(spark, sf):
    return X.similarity_table(K.table(spark, sf, "embeddings"))


@query(f"""WITH RECURSIVE near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE round({_COS}, 6) >= 0.4), core AS (SELECT a FROM near GROUP BY a HAVING count(*) + 1 >= 3),
t AS (SELECT a, b FROM near WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)), reach(x, y) AS (SELECT a, a FROM core UNION SELECT r.x, t.b FROM reach r JOIN t ON r.y = t.a), comp AS (SELECT x, min(y) AS cluster FROM reach GROUP BY x),
border AS (SELECT a, min(b) AS b FROM near WHERE b IN (SELECT a FROM core) AND a NOT IN (SELECT a FROM core) GROUP BY a)
SELECT x AS vec_id, cluster FROM comp UNION ALL SELECT a, cluster FROM border JOIN comp ON x = b""")
def modality_dbscan(spark, sf):
    return X.dbscan(K.table(spark, sf, "embeddings"), 0.6, 3)


@query()
def modality_kmeans(spark, sf):
    return X.kmeans(K.table(spark, sf, "embeddings"), 5)


@query()
def modality_pca(spark, sf):
    return X.pca(K.table(spark, sf, "embeddings"), 2)


@query("SELECT 1.0::DOUBLE AS nodes, 1.0::DOUBLE AS edges, 1.0::DOUBLE AS overall")
def roundtrip_preservation(spark, sf):
    n, e = K.nodes(spark, sf, ("nation", "region")), K.place_edges(spark, sf).filter("relation = 'in_region'")
    back = X.table_to_edges(X.edges_table(e))
    nodes = back.select(F.explode(F.array("src", "tgt")).alias("node")).distinct()
    return X.preservation(n, e, nodes, back)


# evaluation: a benchmark item's text as gold, a document that may hold it as prediction


def _answers(spark, sf):
    """Whole texts: each document with each item that it holds a passage of."""
    b, d = K.table(spark, sf, "benchmark").select("item_id", "text"), K.table(spark, sf, "documents").select("doc_id", "text")
    held = V.passages_held(d, b).join(b.withColumnRenamed("text", "gold"), "item_id").join(d.withColumnRenamed("text", "predicted"), "doc_id")
    return held.select("item_id", "doc_id", "gold", "predicted")


@query()
def qa_bleu4_rouge_l(spark, sf):
    return V.rouge_l(_answers(spark, sf).withColumn("bleu4", V.bleu(F.col("predicted"), F.col("gold"), 4, True))).select("item_id", "doc_id", "bleu4", "rouge_l")


@query()
def qa_meteor_rouge_lsum(spark, sf):
    """Each document against the items that it holds a passage of, as its references: the best of each score."""
    scored = _answers(spark, sf).select("doc_id", alignment_scores(F.col("predicted"), F.array("gold")).alias("s")).select("doc_id", "s.*")
    best = [F.max(c).alias(c) for c in ("meteor", "rouge_lsum", "rouge_lsum_precision", "rouge_lsum_recall")]
    return scored.groupBy("doc_id").agg(F.count("*").alias("n_references"), *best)


@query()
def qa_em_f1(spark, sf):
    return _answers(spark, sf).select("item_id", "doc_id", V.answer_scores(F.col("predicted"), F.col("gold")).alias("s")).select("item_id", "doc_id", "s.*")


@query()
def qa_short_form(spark, sf):
    return V.short_form(_answers(spark, sf))


@query()
def qa_bleu1(spark, sf):
    return _answers(spark, sf).select("item_id", "doc_id", V.bleu(F.col("predicted"), F.col("gold")).alias("bleu1"))


@query(r"""WITH n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS p FROM documents),
h AS (SELECT doc_id, (contains(p, 'of and') OR contains(p, 'thing'))::INT::DOUBLE AS x, contains(p, 'tion')::INT::DOUBLE AS y FROM n) SELECT doc_id, round((x + y) / 2, 6) AS str_em, (x + y = 2)::INT::DOUBLE AS str_hit FROM h""")
def qa_str_hit(spark, sf):
    groups = F.array(F.array(F.lit("of and"), F.lit("Thing!")), F.array(F.lit("the tion")))
    return K.table(spark, sf, "documents").select("doc_id", V.string_hits(F.col("text"), groups).alias("s")).select("doc_id", "s.*")


@whole("o_orderkey < 400")
@query("SELECT o_orderkey, chr(65 + (o_orderkey % 5)::INT) AS option, chr(65 + (o_orderkey % 5)::INT) = 'B' AS right FROM orders WHERE o_orderkey < 400")
def qa_close_set(spark, sf, rows="o_orderkey < 400"):
    o = K.table(spark, sf, "orders").filter(rows)
    letter = F.char(65 + F.col("o_orderkey") % 5)
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("The answer is ("), letter, F.lit(") as before"))).otherwise(F.concat(letter, F.lit(". because")))
    return o.select("o_orderkey", V.option_of(said).alias("option")).withColumn("right", F.col("option") == "B")


_RUNS = """runs AS (SELECT event_id AS id, event_type AS method, (value > 20)::INT::DOUBLE AS em, round(least(1, value / 50), 6) AS f1, value / 10 AS latency_s, user_id % 5 AS n_llm_calls, user_id * 10 AS total_input_tokens, user_id AS total_output_tokens, CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events)"""


def _runs(spark, sf):
    e = K.table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("method"), (F.col("value") > 20).cast("double").alias("em"), F.round(F.least(F.lit(1.0), F.col("value") / 50), 6).alias("f1"), (F.col("value") / 10).alias("latency_s"),
        (F.col("user_id") % 5).alias("n_llm_calls"), (F.col("user_id") * 10).alias("total_input_tokens"), F.col("user_id").alias("total_output_tokens"), F.when(F.col("event_type") == "error", "failed").alias("error"))


@query(f"WITH {_RUNS} SELECT method, count(*) AS n, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1, round(avg(latency_s), 6) AS latency_s, sum(n_llm_calls)::BIGINT AS n_llm_calls, sum(total_input_tokens + total_output_tokens)::BIGINT AS tokens, round(sum(n_llm_calls) / count(*), 6) AS calls_per_question FROM runs GROUP BY method")
def eval_by_method(spark, sf):
    return V.by_method(_runs(spark, sf), "method")


@query(f"WITH {_RUNS} SELECT id, f1 FROM runs WHERE f1 < 0.999999 OR f1 IS NULL")
def eval_failing_ids(spark, sf):
    return V.failing(_runs(spark, sf), "f1")


@query("""WITH c AS (SELECT event_type AS tool, CASE WHEN event_type = 'error' OR value > 60 THEN 'bad' END AS error, user_id % 2 AS k FROM events) SELECT tool, count(*) AS n_calls, count(error) AS n_errors, sum(k)::BIGINT AS n_coercions,
CASE WHEN count(error) = count(*) THEN 'broken' WHEN count(error) > 0 OR sum(k) > 0 THEN 'degraded' ELSE 'ok' END AS status FROM c GROUP BY tool""")
def eval_tool_errors(spark, sf):
    e = K.table(spark, sf, "events").select(F.col("event_type").alias("tool"), F.when((F.col("event_type") == "error") | (F.col("value") > 60), "bad").alias("error"), (F.col("user_id") % 2).alias("n_arg_coercions"))
    return V.tool_errors(e)


@whole("o_orderkey < 500")
@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true ELSE NULL END AS correct FROM orders WHERE o_orderkey < 500""")
def eval_judge_verdicts(spark, sf, rows="o_orderkey < 500"):
    o = K.table(spark, sf, "orders").filter(rows)
    k = F.col("o_orderkey") % 5
    said = (F.when(k == 0, 'Here: ```json\n{"correct": true, "why": "no doubt"}\n```').when(k == 1, 'I think {"verdict": "incorrect"} fits').when(k == 2, "Although true at first, it is wrong.").when(k == 3, "Yes, that is correct.").otherwise("Undecided."))
    return o.select("o_orderkey", V.verdict(said).alias("correct"))


@query("""SELECT round(avg(quality), 6) AS judge, round(avg(toxic), 6) AS tool_errors, round(avg(quality), 6) >= 0.8 AS judge_ok, round(avg(toxic), 6) <= 0.5 AS tool_errors_ok, round(avg(quality), 6) >= 0.8 AND round(avg(toxic), 6) <= 0.5 AS passed FROM labels""")
def gate_eval(spark, sf):
    m = K.table(spark, sf, "labels").agg(F.round(F.avg("quality"), 6).alias("judge"), F.round(F.avg("toxic"), 6).alias("tool_errors"))
    return V.gate(m, {"judge": 0.8}, {"tool_errors": 0.5})


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_samp(value), 6) AS std, round(avg((user_id % 3 = 0)::INT), 6) AS hit_rate, round(avg((value > 40)::INT), 6) AS error_rate FROM events GROUP BY event_type""")
def events_run_stats(spark, sf):
    return V.run_stats(K.table(spark, sf, "events"), "event_type", "value", F.col("value") > 40, F.col("user_id") % 3 == 0)


@query(f"WITH {_RUNS} SELECT count(*) AS n, count(error) AS n_errors, sum(n_llm_calls)::BIGINT AS n_calls, round(avg(latency_s), 6) AS latency_s, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1, round(avg(em) FILTER (error IS NULL), 6) AS em_completed, round(avg(f1) FILTER (error IS NULL), 6) AS f1_completed FROM runs")
def eval_agent_runs(spark, sf):
    return V.agent_runs(_runs(spark, sf))
