"""Memory, patterns, telemetry, coordination and server operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import graph as G
from graphloom.operators import memory as M
from graphloom.operators import server as S
from graphloom.queries.registry import query, whole
from graphloom.sources import commerce as K

_NOW = "2024-02-01 00:00:00"


def _events(spark, sf):
    return K.table(spark, sf, "events")


_MEM = f"""mem AS (SELECT event_id::VARCHAR AS id, event_type AS memory_type, event_type || ' by user ' || user_id AS content, ts, round(least(1, value / 100), 4) AS importance, user_id AS access_count FROM events)"""


def _memories(spark, sf):
    return _events(spark, sf).select(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("memory_type"), F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string")).alias("content"), "ts",
        F.round(F.least(F.lit(1.0), F.col("value") / 100), 4).alias("importance"), F.col("user_id").alias("access_count"), F.col("ts").alias("last_accessed"))


@query(f"WITH {_MEM} SELECT id, importance, access_count FROM mem WHERE memory_type = 'click' AND contains(lower(content), 'user 1') AND ts >= TIMESTAMP '2024-01-05' ORDER BY importance DESC, access_count DESC, id LIMIT 15")
def memory_search(spark, sf):
    return M.search(_memories(spark, sf), "click", "User 1", F.lit("2024-01-05").cast("timestamp"), limit=15).select("id", "importance", "access_count")


@query("""WITH e AS (SELECT DISTINCT event_id AS id, 'user' || (user_id % 40) AS p FROM events UNION SELECT event_id, event_type FROM events) SELECT p AS participant, count(*) AS n, round(count(*) / (SELECT count(DISTINCT id) FROM e), 6) AS confidence FROM e GROUP BY p HAVING count(*) >= 3""")
def memory_consolidate(spark, sf):
    e = _events(spark, sf).select(F.col("event_id").alias("id"), "ts", F.array(F.concat(F.lit("user"), (F.col("user_id") % 40).cast("string")), F.col("event_type")).alias("participants"))
    return M.consolidate(e, F.lit("1970-01-01").cast("timestamp"))


@query(f"WITH {_MEM} SELECT id, round(CASE WHEN ts > TIMESTAMP '2024-01-15' - INTERVAL 1 HOUR THEN importance ELSE importance * 0.95 END, 6) AS importance FROM mem")
def memory_decay(spark, sf):
    return M.decay(_memories(spark, sf), "2024-01-15 00:00:00").select("id", F.round("importance", 6).alias("importance"))


@query(f"""WITH {_MEM} SELECT id, round(least(1, 0.2 * (('click' = memory_type)::INT + 1 + (access_count = 7)::INT) + 0.3 * importance + 0.2 / (1 + greatest(0, (epoch_us(TIMESTAMP '{_NOW}') - epoch_us(ts)) / 86400e6)) + 0.1 * least(1, access_count / 10)), 6) AS relevance FROM mem""")
def memory_relevance(spark, sf):
    return M.relevance("click user 7", _memories(spark, sf), _NOW)


@query(f"WITH {_MEM} SELECT id, ts FROM mem WHERE ts > TIMESTAMP '{_NOW}' - INTERVAL 864000 SECOND ORDER BY ts DESC, id LIMIT 50")
def memory_evict(spark, sf):
    return M.evict(_memories(spark, sf), _NOW, 864000, 50).select("id", "ts")


@query("""WITH RECURSIVE r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f(user_id, i, ema) AS (SELECT user_id, i, value FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.i, 0.3 * r.value + 0.7 * f.ema FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1)
SELECT user_id, round(arg_max(ema, i), 6) AS ema, max(i)::INT AS n FROM f GROUP BY user_id""")
def events_ema(spark, sf):
    return M.ema(_events(spark, sf), "user_id", ["ts", "event_id"], "value").withColumn("n", F.col("n").cast("int"))


@query("""WITH p AS (SELECT event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT a || '>' || b AS pattern, 2 AS length FROM p WHERE b IS NOT NULL UNION ALL SELECT a || '>' || b || '>' || c, 3 FROM p WHERE c IS NOT NULL)
SELECT pattern, length, count(*) AS n, round(least(0.9, count(*) / 4), 6) AS confidence FROM s GROUP BY ALL HAVING count(*) >= 2""")
def events_subsequences(spark, sf):
    return M.subsequences(_events(spark, sf), "user_id", ["ts", "event_id"], "event_type")


@query("""WITH s AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS l FROM events GROUP BY user_id), i AS (SELECT l, unnest(range(1, len(l))) AS i FROM s), r AS (SELECT l, i, unnest(range(2, len(l) - i + 2)) AS n FROM i)
SELECT array_to_string(l[i:i + n - 1], '>') AS pattern, n::INT AS length, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 6) AS frequency, round(least(0.9, count(*) / 4), 6) AS confidence FROM r GROUP BY 1, 2 HAVING count(*) >= 2""")
def events_all_subsequences(spark, sf):
    return M.all_subsequences(_events(spark, sf), "user_id", ["ts", "event_id"], "event_type")


@query(r"""SELECT value, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '@(\w+)', 1)) AS value FROM documents) GROUP BY value ORDER BY n DESC, value LIMIT 10""")
def social_top_mentions(spark, sf):
    d = K.table(spark, sf, "documents").select(F.regexp_extract_all("text", F.lit(r"@(\w+)"), F.lit(1)).alias("mentions"))
    return M.top_terms(d, "mentions")


@query("""SELECT source AS kind, count(*) AS n, count(*) FILTER (quality = 1) AS support, count(*) FILTER (quality = 0) AS deny, round(100 * count(*) FILTER (quality = 1) / count(*), 4) AS rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def social_support_rates(spark, sf):
    d = K.table(spark, sf, "documents").join(K.table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "support").when(F.col("quality") == 0, "deny").alias("label")), "doc_id", "left")
    return M.support_rates(d, "source", "label")


@query("""SELECT doc_id FROM documents WHERE (lang = 'en' AND (contains(lower(text), 'license') OR contains(lower(text), 'chapter'))) OR (lang = 'de' AND contains(lower(text), 'der '))""")
def social_keyword_posts(spark, sf):
    return M.keyword_posts(K.table(spark, sf, "documents"), "lang", "text", {"en": ("License", "chapter"), "de": ("der ",)}).select("doc_id")


@query("""WITH f AS (SELECT unnest([struct_pack("column" := 'o_totalprice', v := o_totalprice::DOUBLE), struct_pack("column" := 'o_custkey', v := o_custkey::DOUBLE)], recursive := true) FROM orders)
SELECT "column", count(*) AS n, round(avg(v), 4) AS mean, round(stddev(v), 4) AS deviation, min(v) AS least, round(quantile_cont(v, 0.25), 4) AS quarter, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS three_quarters, max(v) AS most FROM f GROUP BY 1""")
def social_summaries(spark, sf):
    return M.summaries(K.table(spark, sf, "orders"), ["o_totalprice", "o_custkey"])


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events QUALIFY age <= 20")
def query_history(spark, sf):
    return M.last_queries(_events(spark, sf), "user_id", ["ts", "event_id"], 20).select("user_id", "event_id", "age")


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def session_last_turns(spark, sf):
    return M.last_turns(K.table(spark, sf, "conversations"), 2)


@query("""WITH f AS (SELECT conv_id, turn, text, min(turn) OVER (PARTITION BY conv_id, role) AS first_turn, role FROM conversations) SELECT conv_id, turn, first_turn, first_turn <> turn AS repeat, CASE WHEN first_turn <> turn THEN 'see turn ' || first_turn ELSE role END AS shown FROM f""")
def session_dedup(spark, sf):
    return M.dedup_session(K.table(spark, sf, "conversations"), "role", 40)


@query()
def sequence_pairs(spark, sf):
    """Each user with the next one: no SQL, as longest common subsequences are held against brute force."""
    e = _events(spark, sf).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda r: r["event_type"]).alias("s"))
    pair = e.select(F.col("user_id").alias("x"), F.col("s").alias("a")).join(e.select((F.col("user_id") - 1).alias("x"), F.col("user_id").alias("y"), F.col("s").alias("b")), "x")
    return M.sequence_similarity(pair).select("x", "y", "jaccard", "similarity")


@query("""SELECT 'relation' AS kind, event_type AS name, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'property', 'k', count(*) FROM events WHERE props LIKE '%"k"%'""")
def structure_counts(spark, sf):
    return M.structure_counts(_events(spark, sf).withColumn("p", F.from_json("props", "map<string,string>")), "event_type", "p")


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN CASE WHEN n_regionkey = 1 THEN 0.8 ELSE 0 END WHEN 1 THEN CASE WHEN n_nationkey % 2 = 0 THEN round(1.0 / 3, 6) ELSE 1 END ELSE 0 END::DOUBLE AS similarity FROM nation""")
def structural_similarity(spark, sf):
    n = K.table(spark, sf, "nation")
    own = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    kind = F.when(F.col("n_nationkey") % 3 == 0, "relation").otherwise("properties")
    other = F.when(F.col("n_nationkey") % 3 == 2, "relation").otherwise(kind)
    return n.select("n_nationkey", M.structural_similarity(kind, other, F.col("n_regionkey"), F.lit(1), own, F.array(F.lit("a"), F.lit("b"))).alias("similarity"))


_STRATEGY = "x AS (SELECT event_type AS query_type, 's' || (user_id % 4) AS strategy_id, least(1, value / 60) AS q FROM events), l AS (SELECT * FROM x WHERE q >= 0.7), g AS (SELECT query_type, strategy_id, count(*) AS n, count(*) AS success_count, avg(q) AS q FROM l GROUP BY ALL)"


@query(f"WITH {_STRATEGY} SELECT query_type, strategy_id, n, success_count, round(q, 6) AS quality, 1.0::DOUBLE AS success_rate FROM g QUALIFY row_number() OVER (PARTITION BY query_type ORDER BY round(q, 9) DESC, success_count DESC, strategy_id) = 1")
def strategy_recommendation(spark, sf):
    e = _events(spark, sf).select(F.col("event_type").alias("query_type"), F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("strategy_id"), F.least(F.lit(1.0), F.col("value") / 60).alias("quality_score"))
    return M.recommend(e)


@query("SELECT user_id, event_type AS key, arg_max(props, (ts, event_id)) AS value, count(*) AS updates FROM events GROUP BY ALL")
def preference_upsert(spark, sf):
    return M.preferences(_events(spark, sf).select("user_id", F.col("event_type").alias("key"), F.col("props").alias("value"), "ts", F.col("event_id").alias("seq")))


@query("SELECT p_name || ' ' || p_partkey AS name, p_type AS kind, p_size / 50 AS confidence FROM part WHERE p_type = 'ECONOMY' AND round(p_size / 50, 1) >= 0.8 AND contains(p_name, 'red')")
def pattern_search(spark, sf):
    p = K.table(spark, sf, "part").select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("kind"), (F.col("p_size") / 50).alias("confidence"))
    return M.search_patterns(p, "ECONOMY", ["Red"], 0.8)


@query("SELECT event_type AS tool, count(*) AS n, round(avg((value > 50)::INT), 6) AS error_rate, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def performance_summary(spark, sf):
    return M.performance(_events(spark, sf).withColumnRenamed("event_type", "tool"), "tool", "value", F.col("value") > 50)


@query("""WITH u AS (SELECT event_type AS stage, 'm' || (user_id % 3) AS model, user_id * 10 AS i, user_id AS o FROM events), p AS (SELECT * FROM (VALUES ('m0', 0.5, 1.5), ('m1', 0.1, 0.4)) v(model, a, b)) SELECT stage, model, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, round((sum(i) * coalesce(any_value(a), 0) + sum(o) * coalesce(any_value(b), 0)) / 1000, 6)::DOUBLE AS cost FROM u LEFT JOIN p USING (model) GROUP BY ALL""")
def cost_accounting(spark, sf):
    u = _events(spark, sf).select(F.col("event_type").alias("stage"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), (F.col("user_id") * 10).alias("input_tokens"), F.col("user_id").alias("output_tokens"))
    return M.costs(u, spark.createDataFrame([("m0", 0.5, 1.5), ("m1", 0.1, 0.4)], "model string, input_price double, output_price double"))


@query("SELECT event_type AS level, count(*) FILTER (user_id % 3 > 0) AS hits, count(*) FILTER (user_id % 3 = 0) AS misses, round(count(*) FILTER (user_id % 3 > 0) / count(*), 6) AS hit_rate, round(avg(value) FILTER (user_id % 3 = 0) / avg(value) FILTER (user_id % 3 > 0), 6) AS speedup FROM events GROUP BY event_type")
def cache_statistics(spark, sf):
    return M.cache_stats(_events(spark, sf).select(F.col("event_type").alias("level"), (F.col("user_id") % 3 > 0).alias("hit"), F.col("value").alias("ms")))


@query("SELECT doc_id AS id, 'fact' AS kind, 'judge' AS source, (quality + 1) / 2.0 AS confidence FROM labels WHERE toxic = 0 AND (quality + 1) / 2.0 >= 0.9")
def blackboard_filter(spark, sf):
    l = K.table(spark, sf, "labels")  # noqa: E741
    return M.board(l.select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 0, "fact").otherwise("rumour").alias("kind"), F.lit("judge").alias("source"), ((F.col("quality") + 1) / 2).alias("confidence")), "fact", "judge", 0.9)


@query("SELECT doc_id % 17 AS hypothesis, count(*) AS votes, round(sum(CASE WHEN toxic = 0 THEN quality * 0.8 + 0.1 ELSE 0 END) / count(*), 6) AS confidence FROM labels GROUP BY 1")
def blackboard_votes(spark, sf):
    l = K.table(spark, sf, "labels")  # noqa: E741
    return M.hypothesis_confidence(l.select((F.col("doc_id") % 17).alias("hypothesis"), (F.col("toxic") == 0).alias("valid"), (F.col("quality") * 0.8 + 0.1).alias("confidence")))


@query(f"WITH {K.SQL_PARTS} SELECT entity_name AS entity, count(*) AS n, round(least(0.9, 0.3 + 0.1 * count(*)), 6) AS confidence FROM mentioned GROUP BY entity_name HAVING count(*) >= 4")
def hypothesis_generation(spark, sf):
    return M.hypotheses(K.chunk_parts(spark, sf).select(F.col("chunk_id").alias("id"), F.array("entity_name").alias("entities")), 4)


_BIDS = "b AS (SELECT l_partkey AS task, l_suppkey AS bidder, max(l_extendedprice / 1000) AS score FROM lineitem GROUP BY ALL)"


@query(f"WITH {_BIDS} SELECT task, arg_min(bidder, (-round(score, 9), bidder)) AS bidder, max(round(score, 9)) AS bid FROM b GROUP BY task")
def contract_award(spark, sf):
    return M.award(_bids(spark, sf))


def _bids(spark, sf):
    return K.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("task"), F.col("l_suppkey").alias("bidder")).agg(F.max(F.col("l_extendedprice") / 1000).alias("score"))


@query(f"WITH {_BIDS}, w AS (SELECT *, round(score / (1 + 0.2::DOUBLE * (bidder % 7)), 9) AS bid FROM b) SELECT task, arg_min(bidder, (-bid, bidder)) AS bidder, max(bid) AS bid FROM w GROUP BY task")
def load_balanced_assign(spark, sf):
    return M.award(_bids(spark, sf), F.col("bidder") % 7)


def _questions(spark, sf):
    q = F.when(F.col("n_nationkey") % 2 == 0, "Compare the main exports of Peru and Chile").otherwise("Why did trade change in Rome during 1990")
    return K.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), q.alias("question"))


@query("""SELECT n_nationkey AS id, place, atom, text, needs FROM nation JOIN (VALUES (0, 0, 'entity', 'Compare', ''), (0, 1, 'entity', 'Peru', ''), (0, 2, 'entity', 'Chile', ''), (0, 3, 'relationship', 'comparison', '0,1'), (0, 4, 'attribute', 'main', ''), (0, 5, 'action', 'comparison', '0,1,2,3'),
(1, 0, 'entity', 'Why', ''), (1, 1, 'entity', 'Rome', ''), (1, 2, 'relationship', 'temporal', '0,1'), (1, 3, 'action', 'find_causation', '0,1,2')) v(k, place, atom, text, needs) ON n_nationkey % 2 = k""")
def atom_decomposition(spark, sf):
    return M.atoms(_questions(spark, sf)).select("id", "place", "atom", "text", F.array_join(F.col("depends").cast("array<string>"), ",").alias("needs"))


@query("""SELECT n_nationkey AS id, place, next, p::DOUBLE AS p FROM nation JOIN (VALUES (0, 0, 1, 0.3), (0, 0, 2, 0.3), (0, 1, 0, 0.3), (0, 1, 2, 0.3), (0, 2, 0, 0.3), (0, 2, 1, 0.3), (0, 0, 3, 0.9), (0, 1, 3, 0.9), (0, 2, 3, 0.7), (0, 0, 5, 0.9), (0, 1, 5, 0.9), (0, 2, 5, 0.9), (0, 3, 5, 0.9),
(1, 0, 1, 0.3), (1, 1, 0, 0.3), (1, 0, 2, 0.9), (1, 1, 2, 0.9), (1, 0, 3, 0.9), (1, 1, 3, 0.9), (1, 2, 3, 0.9)) v(k, place, next, p) ON n_nationkey % 2 = k""")
def atom_transitions(spark, sf):
    return M.transitions(M.atoms(_questions(spark, sf)))


@query("SELECT lang AS value, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM documents), 4) AS percent FROM documents GROUP BY lang")
def social_value_shares(spark, sf):
    return M.value_shares(K.table(spark, sf, "documents"), "lang")


@query("SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def social_spanning_accounts(spark, sf):
    return M.spanning(_events(spark, sf), "user_id", "event_type")


@query("SELECT user_id, length(event_type || ' #' || event_type || ' @u' || user_id || ' #x') AS tweet_length, event_type || ',x' AS hashtags, 'u' || user_id AS mentions, CASE user_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'one' END AS conspiracy_theory_name, 2 AS hashtag_count, 1 AS mention_count FROM events")
def social_derived_columns(spark, sf):
    e = _events(spark, sf).select("user_id", F.concat("event_type", F.lit(" #"), "event_type", F.lit(" @u"), F.col("user_id").cast("string"), F.lit(" #x")).alias("tweet"), (F.col("user_id") % 3).cast("int").alias("code"))
    out = M.social_columns(e, "tweet", "code", {0: "none", 1: "one"})
    return out.select("user_id", "tweet_length", F.array_join("hashtags", ",").alias("hashtags"), F.array_join("mentions", ",").alias("mentions"), "conspiracy_theory_name", "hashtag_count", "mention_count")


@query("SELECT CASE WHEN p_size > 25 THEN 'who' ELSE 'what' END AS view, CASE WHEN p_size > 25 AND contains(p_name, 'ring') THEN 'jewel' WHEN p_size > 25 THEN 'actor' WHEN contains(p_name, 'red') THEN 'coloured' ELSE 'thing' END AS type, count(*) AS n FROM part GROUP BY ALL")
def discourse_view_types(spark, sf):
    p = K.table(spark, sf, "part").select(F.when(F.col("p_size") > 25, "who").otherwise("what").alias("view"), F.col("p_name").alias("name"))
    return M.view_types(p, {"who": {"ring": "jewel"}, "what": {"red": "coloured"}}, {"who": "actor", "what": "thing"})


@query("SELECT l_partkey AS src, l_suppkey AS tgt, CASE l_linenumber WHEN 1 THEN 'causes' ELSE 'leads_to' END AS relation, CASE WHEN l_linenumber = 1 THEN 0.5 ELSE l_discount END AS confidence FROM lineitem WHERE l_linenumber <= 2")
def discourse_causal_edges(spark, sf):
    l = K.table(spark, sf, "lineitem")  # noqa: E741
    kind = F.when(F.col("l_linenumber") == 1, "causes").when(F.col("l_linenumber") == 2, "leads_to").otherwise("near")
    return M.causal(l.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("tgt"), kind.alias("relation"), F.when(F.col("l_linenumber") > 1, F.col("l_discount")).alias("confidence")))


@query(f"""WITH RECURSIVE {K.SQL_PLACES}, adj AS (SELECT src, tgt FROM places WHERE relation = 'in_region' UNION SELECT tgt, src FROM places WHERE relation = 'in_region'), r(id, hops) AS (SELECT 'nation:3', 0 UNION SELECT tgt, hops + 1 FROM r JOIN adj ON src = id WHERE hops < 2)
SELECT id, min(hops)::INT AS hops FROM r GROUP BY id HAVING min(hops) > 0 ORDER BY hops, id LIMIT 20""")
def memory_recall(spark, sf):
    e = K.place_edges(spark, sf).filter("relation = 'in_region'")
    return M.recall(G.adjacency(e.select("src", "tgt")).select(F.col("src").alias("id"), F.col("tgt").alias("other")), "nation:3")


@whole("o_orderkey < 100")
@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'comparison' WHEN 1 THEN 'entity_discovery' WHEN 2 THEN 'relationship_analysis' WHEN 3 THEN 'summarization' WHEN 4 THEN 'entity_discovery' ELSE 'general' END AS kind FROM orders WHERE o_orderkey < 100")
def query_classification(spark, sf, rows="o_orderkey < 100"):
    k = F.col("o_orderkey") % 6
    q = F.when(k == 0, "Compare A versus B").when(k == 1, "Who won?").when(k == 2, "the connection of A to B").when(k == 3, "Explain the difference").when(k == 4, "the whole difference").otherwise("why did it fail")
    return K.table(spark, sf, "orders").filter(rows).select("o_orderkey", M.query_type(q).alias("kind"))


# server


@query(f"""WITH {K.SQL_PARTS}, {K.SQL_EDGES}, {K.SQL_NODES}, deg AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM edges UNION ALL SELECT tgt FROM edges) GROUP BY node), c AS (SELECT 'order:' || o_orderkey AS chunk_id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, 1.0 / row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS score FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)),
x AS (SELECT c.chunk_id, c.rank, m.entity_name, list_distinct(list_filter(regexp_extract_all(lower(description), '[a-z0-9]+'), lambda t: (length(t) > 2 OR regexp_full_match(t, '[0-9]+')) AND t NOT IN ('the', 'of', 'for', 'from', 'by', 'with', 'and', 'are', 'was'))) AS t, coalesce(d, 0) AS d, c.score FROM c JOIN mentioned m USING (chunk_id) JOIN nodes n USING (entity_name) LEFT JOIN deg ON node = m.entity_name),
s AS (SELECT chunk_id, rank, entity_name, round(greatest(0, least(1, 0.35 * (len(list_filter(t, lambda w: w IN ('red', 'widget', 'company')))) / len(t) + 0.2 * least(1, d / 20) + 0.2 * score + 0.15 * (1 - (rank - 1) / ((SELECT max(rank) FROM c) - 1)) - 0.1)), 4) AS candidate_score FROM x),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY candidate_score DESC, entity_name) <= 4) SELECT * FROM f ORDER BY candidate_score DESC, rank, entity_name LIMIT 40""")
def candidate_scoring(spark, sf):
    from pyspark.sql import Window as W

    # the ranked chunks: the fifty orders of the highest price
    o = K.table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)
    rank = F.row_number().over(W.orderBy(F.desc("o_totalprice"), "o_orderkey"))
    c = o.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("chunk_id"), rank.alias("rank"), (1.0 / rank).alias("score"))
    return S.score_candidates(c, K.chunk_parts(spark, sf), K.nodes(spark, sf), G.degree(K.edges(spark, sf)), "which red widget company")


@query(f"""WITH {K.SQL_NODES}, {K.SQL_PARTS}, e AS (SELECT entity_name, list_sort(list(DISTINCT chunk_id))[1:5] AS ev FROM mentioned GROUP BY entity_name)
SELECT n.entity_name, entity_type, description[1:280] AS description, n.entity_name || '|' || replace(n.entity_name, ':', ' ') || '|' || description AS aliases, coalesce(array_to_string(ev, ','), '') AS evidence FROM nodes n LEFT JOIN e USING (entity_name) WHERE n.entity_name IN ('part:4', 'supplier:4', 'region:0')""")
def entity_profile(spark, sf):
    names = spark.createDataFrame([("part:4",), ("supplier:4",), ("region:0",)], "entity_name string")
    return S.profiles(K.nodes(spark, sf), K.chunk_parts(spark, sf), names)


@query("""WITH p AS (SELECT 'part:' || p_partkey AS entity_name, p_type AS entity_type, round(p_size / 50, 3) AS score FROM part WHERE p_size / 50 >= 0.5) SELECT entity_name, entity_type, score, entity_type = 'ECONOMY' AS type_match, false AS needs_revision FROM p WHERE contains(entity_name, 'part:1') ORDER BY type_match DESC, score DESC, entity_name LIMIT 7""")
def entity_select_candidate(spark, sf):
    p = K.table(spark, sf, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("entity_name"), F.col("p_type").alias("entity_type"), F.round(F.col("p_size") / 50, 3).alias("score"))
    return S.select_candidate(p, "Part:1", ["economy"], 0.5, 7)


@query("""WITH c AS (SELECT p_brand AS name, 'part:' || p_partkey AS entity_name, round(p_size / 50, 3) AS score FROM part WHERE p_type = 'ECONOMY' AND round(p_size / 50, 3) >= 0.9), b AS (SELECT name, arg_min(entity_name, (-score, entity_name)) AS entity_name, max(score) AS score FROM c GROUP BY name)
SELECT a.name, entity_name, score, entity_name IS NOT NULL AS resolved FROM (SELECT DISTINCT p_brand AS name FROM part UNION SELECT 'Brand#none') a LEFT JOIN b USING (name)""")
def entity_resolve_scored(spark, sf):
    p = K.table(spark, sf, "part")
    c = p.select(F.col("p_brand").alias("name"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("entity_name"), F.col("p_type").alias("entity_type"), F.round(F.col("p_size") / 50, 3).alias("score"))
    return S.resolve_names(c, p.select(F.col("p_brand").alias("name")).union(spark.createDataFrame([("Brand#none",)], "name string")), 0.9, "ECONOMY")


@query()
def entity_fused_search(spark, sf):
    return S.fused_search(K.nodes(spark, sf), "The Red Widget", 10)


@query()
def date_mentions(spark, sf):
    o = K.table(spark, sf, "orders")
    t = F.concat(F.lit("Placed on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(", again in "), F.date_format("o_orderdate", "MMMM yyyy"), F.lit(" and in 1887; shipped 1999-12-31."))
    return S.dates(o.select(F.col("o_orderkey").alias("chunk_id"), t.alias("content")))


@whole("o_orderkey < 300")
@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 2 THEN false ELSE true END AS supported FROM orders WHERE o_orderkey < 300")
def answer_span_support(spark, sf, rows="o_orderkey < 300"):
    o = K.table(spark, sf, "orders").filter(rows)
    k = F.col("o_orderkey") % 3
    span = F.when(k == 0, F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))).when(k == 1, F.concat(F.lit("ORDER-"), F.col("o_orderkey").cast("string"))).otherwise("nowhere")
    return S.span_support(o.select(F.col("o_orderkey").alias("id"), span.alias("span"), F.array(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")), F.lit("order:none")).alias("chunk_ids")), K.chunks(spark, sf))


@query("""SELECT * FROM (VALUES ('find the founder of acme', 'who is the founder of acme', 0.721429), ('count rivers', 'count all rivers', 0.783333)) v(task, atom, score)""")
def plan_atom_match(spark, sf):
    t = spark.createDataFrame([("find the founder of acme", "lookup", "entity", ["a"]), ("count rivers", "count", "number", ["b"])], "task string, op string, kind string, deps array<string>")
    a = spark.createDataFrame([("who is the founder of acme", "lookup", "entity", ["a"], False), ("count all rivers", "count", "number", ["b"], False), ("count rivers", "count", "number", ["b"], True)], "atom string, a_op string, a_kind string, a_deps array<string>, assigned boolean")
    return S.match_atom(t, a)


@query("SELECT n_name AS entity_name, n_name || ' lies in region ' || n_regionkey AS context, round(least(1, (1 + (n_regionkey = 3)::INT) / 3.0 + 0.1), 6) AS score FROM nation")
def bridge_disambiguate(spark, sf):
    n = K.table(spark, sf, "nation")
    return S.bridge_score(n.select(F.col("n_name").alias("entity_name"), F.concat("n_name", F.lit(" lies in region "), F.col("n_regionkey").cast("string")).alias("context")), "region 3 mountains")


@whole("o_orderkey < 200")
@query("""SELECT o_orderkey, kind, fits FROM orders JOIN (VALUES (0, 'yes_no', true), (1, 'entity', false), (2, 'date', true), (3, 'number', true), (4, 'date', true), (5, 'date', false), (6, 'number', false), (7, 'entity', true), (8, 'yes_no', false), (9, 'date', true)) v(k, kind, fits) ON o_orderkey % 10 = k WHERE o_orderkey < 200""")
def answer_kinds(spark, sf, rows="o_orderkey < 200"):
    cases = (
        ("Had it closed?", "Yes"), ("Who was born in 1990?", " "), ("When did it end?", "in may"), ("What amount was paid?", "twenty one"), ("In which year did the person who wrote it die?", "1834"), ("Where was the company founded?", "999"),
        ("The total of all?", "one, two and many more of those"), ("Which river is longest?", "Nile"), ("Is it open?", "maybe"), ("The treaty was signed on what day", "3 Mai 2033"))
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in cases]), (F.col("o_orderkey") % 10 + 1).cast("int"))
    o = K.table(spark, sf, "orders").filter(rows).select("o_orderkey", T.answer_kind(pick(0)).alias("kind"), pick(1).alias("said"))
    return o.select("o_orderkey", "kind", T.matches_kind(F.col("said"), F.col("kind")).alias("fits"))


@whole("o_orderkey < 90")
@query("""SELECT o_orderkey, dated, person FROM orders JOIN (VALUES (0, true, false), (1, false, true), (2, false, false), (3, true, false), (4, false, false), (5, false, true), (6, false, false)) v(k, dated, person) ON o_orderkey % 7 = k WHERE o_orderkey < 90""")
def name_kinds(spark, sf, rows="o_orderkey < 90"):
    names = ("1999, late March", "Ada Lovelace", "the Iron Duke", " 1815 ", "El Greco", "Émile Zola", "2999")
    n = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    o = K.table(spark, sf, "orders").filter(rows).select("o_orderkey", n.alias("n"))
    return o.select("o_orderkey", T.looks_like_date(F.col("n")).alias("dated"), T.looks_like_person(F.col("n")).alias("person"))


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


@query(f"WITH h AS (SELECT a.vec_id AS query_id, 'p' || b.vec_id AS entity_name, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id IN (2, 9) QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, 'p' || b.vec_id) <= 6) SELECT query_id, entity_name, score, coalesce(abs(score - lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, entity_name)) < 0.03, false) AS close FROM h")
def search_guidance(spark, sf):
    from graphloom.operators import retrieval as R

    v = K.table(spark, sf, "embeddings")
    hits = R.vector_top(v.select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("entity_name"), "embedding"), v.filter("vec_id in (2, 9)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 6, "entity_name")
    return S.close_scores(hits.drop("rank"))
