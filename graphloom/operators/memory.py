"""Memory, pattern mining, telemetry, coordination and discourse summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.lineage import written


def search(memories: DataFrame, kind: str | None = None, concept: str | None = None, since=None, until=None, limit: int = 10) -> DataFrame:
    """Memories by type, concept in the text and time, by (importance, access_count) falling."""
    m = memories
    if kind is not None:
        m = m.filter(F.col("memory_type") == kind)
    if concept is not None:
        m = m.filter(F.contains(F.lower("content"), F.lit(concept.lower())))
    if since is not None:
        m = m.filter(F.col("ts") >= since)
    if until is not None:
        m = m.filter(F.col("ts") <= until)
    return m.orderBy(F.desc("importance"), F.desc("access_count"), "id").limit(limit)


def consolidate(episodes: DataFrame, since, least: int = 3) -> DataFrame:
    """Participants of at least ``least`` episodes since then: participant, n, confidence = n / episodes."""
    e = episodes.filter(F.col("ts") >= since)
    total = F.broadcast(e.agg(F.countDistinct("id").alias("_t")))
    n = e.select("id", F.explode("participants").alias("participant")).distinct().groupBy("participant").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return n.crossJoin(total).select("participant", "n", F.round(F.col("n") / F.col("_t"), 6).alias("confidence"))


def decay(memories: DataFrame, now, factor: float = 0.95) -> DataFrame:
    """Importance x factor where the last access isn't under an hour old."""
    recent = F.col("last_accessed") > F.lit(now).cast("timestamp") - F.expr("interval 1 hour")
    return memories.withColumn("importance", F.when(F.coalesce(recent, F.lit(False)), F.col("importance")).otherwise(F.col("importance") * factor))


def relevance(query: str, memories: DataFrame, now, keys: list[str] | None = None) -> DataFrame:
    """0.2 for each shared word + 0.3 importance + 0.2 / (1 + age in days) + 0.1 min(1, accesses / 10) + 0.2 for each shared key, at most 1.

    Ages count fractions of days; a time to come counts as now.
    """
    q = F.array(*[F.lit(w) for w in sorted(set(query.lower().split()))]) if query.split() else F.array().cast("array<string>")
    shared = F.size(F.array_intersect(q, T.words(F.lower("content"))))
    days = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400e6)
    k = F.size(F.array_intersect(F.map_keys("metadata"), F.array(*[F.lit(x) for x in keys]))) if keys else F.lit(0)
    score = 0.2 * shared + 0.3 * F.col("importance") + 0.2 / (1 + days) + 0.1 * F.least(F.lit(1.0), F.col("access_count") / 10) + 0.2 * F.coalesce(k, F.lit(0))
    return memories.select("id", F.round(F.least(F.lit(1.0), score), 6).alias("relevance"))


def evict(entries: DataFrame, now, ttl_s: int, most: int) -> DataFrame:
    """Entries younger than the time to live, the ``most`` accessed last."""
    alive = entries.filter(F.col("ts") > F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(ttl_s)))
    return alive.orderBy(F.desc("last_accessed"), "id").limit(most)


def ema(rows: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.3) -> DataFrame:
    """Per key the exponential moving average in order, from the first value: key, ema, n.

    The average equals a weighted sum with weight alpha (1 - alpha)^(n - i), so it's a plain
    aggregate over row numbers: no sequence is gathered.
    """
    w = W.partitionBy(key)
    r = rows.select(key, F.col(value).cast("double").alias("v"), F.row_number().over(w.orderBy(*order)).alias("i"), F.count("*").over(w).alias("n"))
    weight = F.when(F.col("i") == 1, F.pow(F.lit(1 - alpha), F.col("n") - 1)).otherwise(alpha * F.pow(F.lit(1 - alpha), F.col("n") - F.col("i")))
    return r.groupBy(key).agg(F.round(F.sum(weight * F.col("v")), 6).alias("ema"), F.max("n").alias("n"))


# Kinds of questions by what they contain, the first that fits; hints of relationships, attributes and actions.
QUERY_TYPES = {"entity_discovery": "who|person|people|entity", "relationship_analysis": "relationship|connection|between", "summarization": "summarize|overview|explain", "comparison": "compare|difference|similar"}
ENTITY_KEYWORDS = ("what", "who", "which", "where", "about", "regarding")
RELATION_HINTS = {
    "caused": ("caused", "led to", "resulted in", "influence"), "related": ("related to", "connected to", "associated with"), "part_of": ("part of", "belongs to", "member of"),
    "temporal": ("before", "after", "during", "while"), "comparison": ("compare", "versus", "vs", "different from"), "influence": ("influence", "affect", "impact", "shape")}
ATTRIBUTE_HINTS = ("main", "primary", "important", "significant", "key", "major", "causes", "effects", "characteristics")
TIME_HINTS = ("recent", "latest", "historical", "past", "current", "future")
ACTIONS = {"what": "retrieve_information", "how": "explain_process", "why": "find_causation", "when": "temporal_search", "where": "location_search"}


def query_type(c: Column) -> Column:
    """A question's kind by the words it contains, parts of words too; general without any."""
    low, out = F.lower(c), None
    for kind, hints in QUERY_TYPES.items():
        out = F.when(low.rlike(hints), kind) if out is None else out.when(low.rlike(hints), kind)
    return out.otherwise("general")


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation."""
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def dedup_session(turns: DataFrame, text_col: str = "text", size: int = 1200) -> DataFrame:
    """Turns in order with repeated texts of a conversation replaced by a reference to the first, long ones cut to ``size``: conv_id, turn, first_turn, repeat, shown."""
    w = W.partitionBy("conv_id", text_col).orderBy("turn")
    first = F.first("turn").over(w)
    repeat = first != F.col("turn")
    return turns.select("conv_id", "turn", first.alias("first_turn"), repeat.alias("repeat"), F.when(repeat, F.concat(F.lit("see turn "), first.cast("string"))).otherwise(F.substring(text_col, 1, size)).alias("shown"))


def subsequences(events: DataFrame, key: str, order: list[str], item: str, lengths: tuple[int, ...] = (2, 3), support: int = 2) -> DataFrame:
    """Contiguous runs of items of the given lengths met at least ``support`` times: pattern, length, n, confidence = min(0.9, n / (2 support)).

    Runs come from a window over each key's order, so no sequence is gathered.
    """
    w = W.partitionBy(key).orderBy(*order)
    out = None
    for n in lengths:
        run = events.select(*[F.lead(item, i).over(w).alias(f"_{i}") for i in range(n)]).filter(f"_{n - 1} is not null")
        one = run.groupBy(F.concat_ws(">", *[f"_{i}" for i in range(n)]).alias("pattern")).agg(F.count("*").alias("n")).filter(F.col("n") >= support).withColumn("length", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out.select("pattern", "length", "n", F.round(F.least(F.lit(0.9), F.col("n") / (2 * support)), 6).alias("confidence"))


def all_subsequences(events: DataFrame, key: str, order: list[str], item: str, least: int = 2, support: int = 2) -> DataFrame:
    """Contiguous runs of items of every length from ``least`` on that are met at least ``support`` times: as :func:`subsequences`, plus frequency = n / number of keys.

    Lengths grow one by one: a run of n is looked at only where both runs of n - 1 in it were frequent, so a level holds frequent places
    only, and the last level is the first with none. Null items part runs. Every level is written and read back.
    """
    w = W.partitionBy(key).orderBy(*order)
    at = events.select(F.col(key).alias("key"), F.row_number().over(w).alias("place"), F.col(item).cast("string").alias("last")).filter("last is not null")
    live, out, keys = written(at.withColumn("pattern", F.col("last"))), [], events.select(key).distinct().count()
    length, step = 1, W.partitionBy("key").orderBy("place")
    while True:
        often = written(live.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= support))
        if often.isEmpty():
            break
        if length >= least:
            out.append(often.withColumn("length", F.lit(length)))
        known = live.join(often.select("pattern"), "pattern", "left_semi")
        grown = known.select("key", "place", F.lead("place").over(step).alias("next"), F.lead("last").over(step).alias("last"), "pattern").filter("next = place + 1")
        live, length = written(grown.select("key", "place", "last", F.concat_ws(">", "pattern", "last").alias("pattern"))), length + 1
    found = reduce(DataFrame.unionByName, out) if out else live.groupBy("pattern").agg(F.count("*").alias("n")).limit(0).withColumn("length", F.lit(0))
    return found.select("pattern", "length", "n", F.round(F.col("n") / max(1, keys), 6).alias("frequency"), F.round(F.least(F.lit(0.9), F.col("n") / (2 * support)), 6).alias("confidence"))


def sequence_similarity(pairs: DataFrame) -> DataFrame:
    """0.4 Jaccard + 0.6 x 2 LCS / (m + n) of arrays a and b."""

    @F.pandas_udf("double")
    def lcs(a, b):
        import pandas as pd

        out = []
        for x, y in zip(a, b, strict=True):
            row = [0] * (len(y) + 1)
            for w in x:
                last = 0
                for j, v in enumerate(y, 1):
                    row[j], last = (last + 1 if w == v else max(row[j], row[j - 1])), row[j]
            out.append(2 * row[-1] / (len(x) + len(y)) if len(x) + len(y) else 1.0)
        return pd.Series(out)

    union = F.size(F.array_union("a", "b"))
    j = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("a", "b")) / union)
    return pairs.withColumns({"jaccard": F.round(j, 6), "similarity": F.round(0.4 * j + 0.6 * lcs("a", "b"), 6)})


def structural_similarity(kind_a: Column, kind_b: Column, relation_a: Column, relation_b: Column, keys_a: Column, keys_b: Column) -> Column:
    """Of two structures of one kind: relations 0.8 if equal, properties the Jaccard similarity of their keys; else 0."""
    both = F.size(F.array_intersect(keys_a, keys_b))
    shared = F.when(both > 0, both / F.size(F.array_union(keys_a, keys_b)))
    same = F.when(kind_a == "relation", F.when(relation_a == relation_b, 0.8)).when(kind_a == "properties", shared)
    return F.round(F.coalesce(F.when(kind_a == kind_b, same), F.lit(0.0)), 6)


def structure_counts(rows: DataFrame, relation: str, properties: str) -> DataFrame:
    """Counts per relation and per property key: kind, name, n."""
    a = rows.groupBy(F.lit("relation").alias("kind"), F.col(relation).alias("name")).agg(F.count("*").alias("n"))
    b = rows.select(F.explode(F.map_keys(properties)).alias("name")).groupBy(F.lit("property").alias("kind"), "name").agg(F.count("*").alias("n"))
    return a.unionByName(b)


def recommend(runs: DataFrame, learn: float = 0.7, ok: float = 0.6) -> DataFrame:
    """Per query type the best learnt strategy: quality x success rate, then successes, with rate >= 0.7 and quality >= 0.6.

    Runs below ``learn`` quality teach nothing; one counts as a success from ``ok``.
    """
    g = runs.filter(F.col("quality_score") >= learn).groupBy("query_type", "strategy_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("quality_score") >= ok).alias("success_count"), F.avg("quality_score").alias("q"), F.avg((F.col("quality_score") >= ok).cast("double")).alias("r"))
    w = W.partitionBy("query_type").orderBy(F.desc(F.round(F.col("q") * F.col("r"), 9)), F.desc("success_count"), "strategy_id")
    best = g.filter("r >= 0.7 and q >= 0.6").withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return best.select("query_type", "strategy_id", "n", "success_count", F.round("q", 6).alias("quality"), F.round("r", 6).alias("success_rate"))


def preferences(updates: DataFrame) -> DataFrame:
    """Last value and number of updates per (user, key)."""
    return updates.groupBy("user_id", "key").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"), F.count("*").alias("updates"))


def search_patterns(patterns: DataFrame, kind: str | None, words: list[str], least: float) -> DataFrame:
    """Patterns of a kind, confidence rounded to a tenth at least ``least``, with every word in the name; by confidence falling."""
    p = patterns.filter(F.round("confidence", 1) >= least)
    if kind:
        p = p.filter(F.col("kind") == kind)
    for w in words:
        p = p.filter(F.contains(F.lower("name"), F.lit(w.lower())))
    return p.orderBy(F.desc("confidence"), "name")


def performance(calls: DataFrame, name: str, value: str, error: Column) -> DataFrame:
    """Per function: n, error_rate, mean, min, max, total."""
    return calls.groupBy(name).agg(F.count("*").alias("n"), F.round(F.avg(error.cast("double")), 6).alias("error_rate"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.sum(value), 4).alias("total"))


def costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost per (stage, model); prices are per 1000 tokens and few."""
    u = usage.groupBy("stage", "model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    p = u.join(prices, "model", "left")
    return p.select("stage", "model", "input_tokens", "output_tokens", F.round((F.col("input_tokens") * F.coalesce("input_price", F.lit(0.0)) + F.col("output_tokens") * F.coalesce("output_price", F.lit(0.0))) / 1000, 6).alias("cost"))


def cache_stats(lookups: DataFrame) -> DataFrame:
    """Per level: hits, misses, hit_rate and speed-up (mean time of a miss over that of a hit)."""
    g = lookups.groupBy("level").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.avg(F.when(F.col("hit"), F.col("ms"))).alias("_h"), F.avg(F.when(~F.col("hit"), F.col("ms"))).alias("_m"))
    return g.select("level", "hits", "misses", F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 6).alias("hit_rate"), F.round(F.col("_m") / F.when(F.col("_h") > 0, F.col("_h")), 6).alias("speedup"))


def board(items: DataFrame, kind: str | None = None, source: str | None = None, least: float = 0.0) -> DataFrame:
    """Blackboard entries by type, source and confidence, the most confident first."""
    i = items.filter(F.col("confidence") >= least)
    if kind:
        i = i.filter(F.col("kind") == kind)
    if source:
        i = i.filter(F.col("source") == source)
    return i.orderBy(F.desc("confidence"), "id")


def hypothesis_confidence(votes: DataFrame) -> DataFrame:
    """Per hypothesis: confidence of the valid votes over the number of all votes."""
    return votes.groupBy("hypothesis").agg(F.count("*").alias("votes"), F.round(F.sum(F.when(F.col("valid"), F.col("confidence")).otherwise(0.0)) / F.count("*"), 6).alias("confidence"))


def hypotheses(items: DataFrame, least: int = 2) -> DataFrame:
    """Entities that at least ``least`` facts or inferences mention: entity, n, confidence = min(0.9, 0.3 + 0.1 n)."""
    n = items.select("id", F.explode("entities").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return n.withColumn("confidence", F.round(F.least(F.lit(0.9), 0.3 + 0.1 * F.col("n")), 6))


def award(bids: DataFrame, load: Column | None = None) -> DataFrame:
    """Per task the best bid, its score divided by 1 + 0.2 load where a load is given; ties to the least bidder."""
    s = F.col("score") / (1 + 0.2 * load) if load is not None else F.col("score")
    rated = bids.withColumn("bid", F.round(s, 9))
    return rated.groupBy("task").agg(F.min_by("bidder", F.struct(-F.col("bid"), F.col("bidder"))).alias("bidder"), F.max("bid").alias("bid"))


def atoms(questions: DataFrame) -> DataFrame:
    """Typed atoms of each question: id, place, atom (entity, relationship, attribute, action), text, depends (places of the atoms it needs).

    Entities are capitalised words, pairs of them and quoted phrases, in order of appearance; a relationship is hinted at by
    a phrase and needs two entities, the first two; an action needs all entities and relationships.
    """
    q, low = F.col("question"), F.lower("question")
    w = T.words(q)
    upper = lambda x: x.rlike(r"^\p{Lu}")
    at = F.transform(w, lambda x, i: F.when(upper(x), F.array_compact(F.array(F.when(~F.lower(x).isin(*ENTITY_KEYWORDS), x), F.when(upper(F.get(w, i + 1)), F.concat(x, F.lit(" "), F.get(w, i + 1)))))).otherwise(F.array().cast("array<string>")))
    ents = F.array_distinct(F.concat(F.flatten(at), F.regexp_extract_all(q, F.lit('"([^"]*)"'), F.lit(1))))
    has = lambda hints: F.greatest(*[F.contains(low, F.lit(h)) for h in hints]) if len(hints) > 1 else F.contains(low, F.lit(hints[0]))
    rels = F.array_compact(F.array(*[F.when(has(hints), F.lit(kind)) for kind, hints in RELATION_HINTS.items()]))
    attrs = F.array_compact(F.array(*[F.when(has((h,)), F.lit(h)) for h in ATTRIBUTE_HINTS], *[F.when(has((h,)), F.lit(f"temporal:{h}")) for h in TIME_HINTS]))
    action = None
    for word, name in ACTIONS.items():
        action = F.when(F.startswith(low, F.lit(word)), name) if action is None else action.when(F.startswith(low, F.lit(word)), name)
    action = action.when(F.contains(low, F.lit("compare")), "comparison").when(low.rlike("list|enumerate"), "enumeration").otherwise("general_search")
    none = F.array().cast("array<int>")
    kind = lambda atom, texts, needs: F.transform(texts, lambda x: F.struct(F.lit(atom).alias("atom"), x.alias("text"), needs.alias("depends")))
    found = questions.select("id", ents.alias("e"), rels.alias("r"), attrs.alias("a"), action.alias("act"))
    found = found.withColumn("r", F.when(F.size("e") >= 2, F.col("r")).otherwise(F.array().cast("array<string>")))
    before = F.size("e") + F.size("r")
    needs = F.when(before > 0, F.sequence(F.lit(0), before - 1)).otherwise(none)
    states = F.concat(kind("entity", F.col("e"), none), kind("relationship", F.col("r"), F.array(F.lit(0), F.lit(1))), kind("attribute", F.col("a"), none), kind("action", F.array("act"), needs))
    return found.select("id", F.posexplode(states).alias("place", "t")).select("id", "place", "t.atom", "t.text", "t.depends")


def transitions(found: DataFrame) -> DataFrame:
    """Ordered pairs of a question's atoms with the weight of going from one to the other: id, place, next, p; pairs without weight go.

    0.9 to an atom that depends on the first, 0.3 within a kind, 0.7 from an entity to a relationship, 0.8 from an entity or
    relationship to an action. A question's atoms are few, so its pairs are.
    """
    a = found.select("id", "place", F.col("atom").alias("x"))
    b = found.select("id", F.col("place").alias("next"), F.col("atom").alias("y"), "depends")
    p = (F.when(F.array_contains("depends", F.col("place")), 0.9).when(F.col("x") == F.col("y"), 0.3).when((F.col("x") == "entity") & (F.col("y") == "relationship"), 0.7)
         .when((F.col("y") == "action") & F.col("x").isin("entity", "relationship"), 0.8))
    return a.join(b, "id").filter("place <> next").select("id", "place", "next", p.alias("p")).filter("p is not null")


def value_shares(rows: DataFrame, col: str) -> DataFrame:
    """Values with count and percentage."""
    total = F.broadcast(rows.agg(F.count("*").alias("_t")))
    return rows.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).crossJoin(total).select("value", "n", F.round(100 * F.col("n") / F.col("_t"), 4).alias("percent"))


def top_terms(rows: DataFrame, terms: str, k: int = 10) -> DataFrame:
    """The ``k`` values most often in an array column, such as hashtags or mentions: value, n; ties by value."""
    return rows.select(F.explode(terms).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def keyword_posts(rows: DataFrame, kind: str, text: str, keywords: dict[str, tuple[str, ...]]) -> DataFrame:
    """``rows`` whose text holds a keyword of its kind, in any case of letters; kinds without keywords have none."""
    hit = F.lit(False)
    for k, words in keywords.items():
        own = F.lit(False)
        for w in words:
            own = own | F.contains(F.lower(F.col(text)), F.lit(w.lower()))
        hit = hit | ((F.col(kind) == k) & own)
    return rows.filter(hit)


def support_rates(rows: DataFrame, kind: str, label: str, support: str = "support", deny: str = "deny") -> DataFrame:
    """kind, n, support, deny, rate (per cent of all rows of the kind that support)."""
    g = rows.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(label) == support, F.lit(False))).alias("support"), F.count_if(F.coalesce(F.col(label) == deny, F.lit(False))).alias("deny"))
    return g.withColumn("rate", F.round(100 * F.col("support") / F.col("n"), 4))


def summaries(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, mean, deviation (of a sample), least, quarter, median, three_quarters, most of numeric columns, nulls aside; quartiles are exact."""
    flat = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").filter("v is not null")
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")
    g = flat.groupBy("column").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev("v").alias("deviation"), F.min("v").alias("least"), F.max("v").alias("most"), q)
    r = lambda c: F.round(c, 4)
    return g.select("column", "n", r("mean").alias("mean"), r("deviation").alias("deviation"), "least", r(F.col("q")[0]).alias("quarter"), r(F.col("q")[1]).alias("median"), r(F.col("q")[2]).alias("three_quarters"), "most")


def last_queries(rows: DataFrame, key: str, order: list[str], most: int = 100) -> DataFrame:
    """The last ``most`` rows of each key, with ``age``, from 1 for the newest."""
    w = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= most)


def spanning(rows: DataFrame, account: str, kind: str) -> DataFrame:
    """Accounts that appear under more than one kind."""
    return rows.groupBy(account).agg(F.countDistinct(kind).alias("kinds")).filter("kinds > 1")


def social_columns(posts: DataFrame, text: str, code: str, names: dict[int, str]) -> DataFrame:
    """Derived columns of posts: length, hashtags and mentions with their counts, the code's name."""
    tags = lambda mark: F.regexp_extract_all(F.col(text), F.lit(mark + r"(\w+)"), F.lit(1))
    name = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return posts.withColumns({"tweet_length": F.length(text), "hashtags": tags("#"), "mentions": tags("@"), "conspiracy_theory_name": F.try_element_at(name, F.col(code))}).withColumns({"hashtag_count": F.size("hashtags"), "mention_count": F.size("mentions")})


def view_types(entities: DataFrame, rules: dict[str, dict[str, str]], defaults: dict[str, str]) -> DataFrame:
    """Entity types per view: the first rule whose word is in the name, else the view's default: view, type, n."""
    kind = None
    for view, words in rules.items():
        for word, t in words.items():
            hit = (F.col("view") == view) & F.contains(F.lower("name"), F.lit(word))
            kind = F.when(hit, t) if kind is None else kind.when(hit, t)
    default = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.lit(v))])
    typed = entities.select("view", (F.coalesce(kind, F.try_element_at(default, F.col("view"))) if kind is not None else F.try_element_at(default, F.col("view"))).alias("type"))
    return typed.groupBy("view", "type").agg(F.count("*").alias("n"))


def causal(edges: DataFrame, relations: tuple[str, ...] = ("causes", "leads_to", "influences")) -> DataFrame:
    """Edges of causal relations with confidence (0.5 where there is none)."""
    return edges.filter(F.col("relation").isin(*relations)).withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))


def recall(associations: DataFrame, start: str, depth: int = 2, limit: int = 20) -> DataFrame:
    """Memories within ``depth`` associations (id, other) of a start: id, hops; nearest first."""
    seen = associations.sparkSession.createDataFrame([(start, 0)], "id string, hops int")
    for h in range(1, depth + 1):
        last = seen.filter(F.col("hops") == h - 1).select("id")
        new = associations.join(last, "id").select(F.col("other").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(h))
        seen = seen.unionByName(new)
    return seen.filter("hops > 0").orderBy("hops", "id").limit(limit)
