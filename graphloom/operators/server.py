"""Operators that add query semantics on top of retrieval: fusion, profiles, candidates, dates, evidence."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import retrieval as R

#: citations of one chunk that a task takes
HOT = 100_000


def name_variants(query: str) -> list[str]:
    """The query as it is, cleaned, and without a leading title."""
    import re

    clean = " ".join(re.sub("[^a-z0-9 ]", " ", query.lower()).split())
    bare = re.sub(r"^(mr|mrs|ms|dr|sir|the) ", "", clean)
    return list(dict.fromkeys(x for x in (query, clean, bare) if x))


def fused_search(nodes: DataFrame, query: str, k: int) -> DataFrame:
    """TF-IDF lists of each variant of the query, joined by reciprocal rank fusion."""
    ranked = None
    for v in name_variants(query):
        top = R.Tfidf(nodes.select("entity_name", F.concat_ws(" ", "entity_name", "description").alias("text")), "entity_name", "text").top(v, 2 * k)
        top = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "entity_name")))
        ranked = top if ranked is None else ranked.unionByName(top)
    return R.rrf(ranked, "entity_name").limit(k)


def close_scores(hits: DataFrame, gap: float = 0.03) -> DataFrame:
    """Adds ``close``: whether the next hit's score is within the gap."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "entity_name")
    return hits.withColumn("close", F.coalesce(F.abs(F.col("score") - F.lead("score").over(w)) < gap, F.lit(False)))


def resolve_names(candidates: DataFrame, asked: DataFrame, threshold: float, kind: str | None = None) -> DataFrame:
    """Best candidate (name, entity_name, entity_type, score) per asked name: name, entity_name, score, resolved."""
    c = candidates.filter(F.col("score") >= threshold)
    if kind:
        c = c.filter(F.col("entity_type") == kind)
    best = c.groupBy("name").agg(F.min_by(F.struct("entity_name", "score"), F.struct(-F.col("score"), F.col("entity_name"))).alias("b"))
    return asked.select("name").distinct().join(best, "name", "left").select("name", "b.entity_name", "b.score", F.col("b").isNotNull().alias("resolved"))


def profiles(nodes: DataFrame, mentions: DataFrame, names: DataFrame, aliases: int = 12, refs: int = 5) -> DataFrame:
    """Canonical name, type, description (280 characters), aliases and evidence of the named entities."""
    own = nodes.join(names, "entity_name", "left_semi")
    ev = mentions.join(names, "entity_name", "left_semi").groupBy("entity_name").agg(F.slice(F.array_sort(F.collect_set("chunk_id")), 1, refs).alias("evidence"))
    other = F.slice(F.array_distinct(F.array_compact(F.array(F.col("entity_name"), T.clean(F.col("entity_name")), F.col("description")))), 1, aliases)
    return own.join(ev, "entity_name", "left").select(
        "entity_name", F.coalesce(F.nullif("entity_type", F.lit("")), F.lit("unknown")).alias("entity_type"), F.substring("description", 1, 280).alias("description"), F.array_join(other, "|").alias("aliases"),
        F.coalesce(F.array_join("evidence", ","), F.lit("")).alias("evidence"))


def select_candidate(pool: DataFrame, name: str | None, expected: list[str], threshold: float, k: int) -> DataFrame:
    """Candidates (entity_name, entity_type, score) whose name holds ``name`` (all if none does), best score per entity,
    right types first, at least the threshold: the k best, with needs_revision where the first doesn't match."""
    hit = F.contains(F.lower("entity_name"), F.lit((name or "").lower()))
    p = pool.withColumn("_h", hit).withColumn("_any", F.max(F.col("_h").cast("int")).over(W.partitionBy()))
    p = p.filter(F.col("_h") | (F.col("_any") == 0)).groupBy("entity_name", "entity_type").agg(F.max("score").alias("score"))
    match = T.coarse_type(F.col("entity_type")).isin(*expected) if expected else F.lit(True)
    p = p.withColumn("type_match", match).filter(F.col("score") >= threshold)
    top = p.orderBy(F.desc("type_match"), F.desc("score"), "entity_name").limit(k)
    return top.withColumn("needs_revision", ~F.first("type_match").over(W.orderBy(F.desc("type_match"), F.desc("score"), "entity_name")))


def score_candidates(chunks: DataFrame, mentions: DataFrame, nodes: DataFrame, degree: DataFrame, query: str, per_chunk: int = 4, total: int = 40) -> DataFrame:
    """Entities of ranked chunks (chunk_id, rank, score): chunk_id, entity_name, candidate_score; four a chunk, forty in all.

    0.35 overlap + 0.20 min(1, degree / 20) + 0.20 chunk score / best + 0.15 rank signal + 0.20 type match - 0.1 for a
    known other type, within 0..1. The ranked chunks are a result list, so a handful.
    """
    best = F.broadcast(chunks.agg(F.greatest(F.max("score"), F.lit(1e-6)).alias("_best"), F.greatest(F.max("rank") - 1, F.lit(1)).alias("_last")))
    own = mentions.join(chunks, "chunk_id").crossJoin(best).join(nodes.select("entity_name", "entity_type", "description"), "entity_name").join(degree.select(F.col("node").alias("entity_name"), "degree"), "entity_name", "left")
    q = nodes.sparkSession.createDataFrame([(query,)], "q string").select(T.signal_tokens(F.col("q")).alias("_q"), T.expected_types(F.col("q")).alias("_e"))
    own = own.crossJoin(F.broadcast(q))
    name = T.signal_tokens(F.col("description"))
    overlap = F.when((F.size("_q") > 0) & (F.size(name) > 0), F.size(F.array_intersect("_q", name)) / F.size(name)).otherwise(0.0)
    kind = T.coarse_type(F.col("entity_type"))
    match = F.exists("_e", lambda t: F.contains(t, kind) | F.contains(kind, t))
    asked = F.size("_e") > 0
    one = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    score = (0.35 * overlap + 0.20 * F.least(F.lit(1.0), F.coalesce("degree", F.lit(0)) / 20) + 0.20 * one(F.col("score") / F.col("_best")) + 0.15 * one(1 - (F.col("rank") - 1) / F.col("_last"))
             + F.when(asked & match, 0.20).otherwise(0.0) - F.when(asked & ~match & (kind != "unknown"), 0.1).otherwise(0.0))
    rated = own.select("chunk_id", "rank", "entity_name", F.round(one(score), 4).alias("candidate_score"))
    w = W.partitionBy("chunk_id").orderBy(F.desc("candidate_score"), "entity_name")
    few = rated.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_chunk).drop("_r")
    return few.orderBy(F.desc("candidate_score"), "rank", "entity_name").limit(total)


_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
_DATES = ((rf"\b(?:{_MONTH})\s+[0-9]{{1,2}},?\s+[0-9]{{4}}\b|\b[0-9]{{1,2}}\s+(?:{_MONTH})\s+[0-9]{{4}}\b|\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\b", "day"), (rf"\b(?:{_MONTH})\s+[0-9]{{4}}\b", "month"), (r"\b(?:1[0-9]{3}|20[0-9]{2})\b", "year"))


def dates(chunks: DataFrame, most: int | None = None) -> DataFrame:
    """Date mentions of each chunk: normalized_date, precision, char_start, char_end, snippet; a finer one hides those inside it.

    Each date once a chunk, in order of place; all of them, or the first ``most`` a chunk where asked for.
    """

    def run(batches: Iterator) -> Iterator:
        import re

        import pandas as pd

        months = {m.lower(): i + 1 for i, m in enumerate(_MONTH.split("|"))}

        def normal(text: str, precision: str) -> str:
            if precision == "year":
                return text
            if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
                return text
            m = next(months[w] for w in re.findall("[a-z]+", text.lower()) if w in months)
            year = re.search("[0-9]{4}", text)[0]
            if precision == "month":
                return f"{year}-{m:02d}"
            return f"{year}-{m:02d}-{int(re.search(r'(?<![0-9])[0-9]{1,2}(?![0-9])', text)[0]):02d}"

        for b in batches:
            rows = []
            for c, t in zip(b["chunk_id"], b["content"], strict=True):
                taken, seen, own = [], set(), []
                for pattern, precision in _DATES:
                    for m in re.finditer(pattern, t or "", re.I):
                        if any(m.start() < e and s < m.end() for s, e in taken):
                            continue
                        taken.append(m.span())
                        d = normal(m[0], precision)
                        if (d, precision) not in seen:
                            seen.add((d, precision))
                            own.append((c, d, precision, m.start(), m.end(), t[max(0, m.start() - 40) : m.end() + 40]))
                rows += sorted(own, key=lambda r: r[3])[:most]
            yield pd.DataFrame(rows, columns=["chunk_id", "normalized_date", "precision", "char_start", "char_end", "snippet"])

    return chunks.select(F.col("chunk_id").cast("string"), "content").mapInPandas(run, "chunk_id string, normalized_date string, precision string, char_start int, char_end int, snippet string")


def bridge_score(candidates: DataFrame, clue: str) -> DataFrame:
    """Clue overlap + 0.15 where the name has two words or more + 0.10 where the context names it, at most 1."""
    q = F.array(*[F.lit(w) for w in sorted(set(clue.lower().split()) - set(T.STOPWORDS))])
    own = F.array_distinct(T.tokens(F.concat_ws(" ", "entity_name", "context")))
    s = F.size(F.array_intersect(q, own)) / F.greatest(F.size(q), F.lit(1)) + F.when(F.size(T.words(F.col("entity_name"))) >= 2, 0.15).otherwise(0.0) + F.when(F.contains(F.lower("context"), F.lower("entity_name")), 0.10).otherwise(0.0)
    return candidates.withColumn("score", F.round(F.least(F.lit(1.0), s), 6)).orderBy(F.desc("score"), "entity_name")


def jaccard(a: Column, b: Column) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / u)


def match_atom(tasks: DataFrame, atoms: DataFrame) -> DataFrame:
    """Best unassigned atom of each task: 0.65 token Jaccard + 0.15 same op + 0.10 same kind + 0.10 dependency Jaccard. Both are plan-sized."""
    pair = tasks.join(F.broadcast(atoms.filter("not assigned")))
    s = 0.65 * jaccard(T.tokens(F.col("task")), T.tokens(F.col("atom"))) + 0.15 * (F.col("op") == F.col("a_op")).cast("double") + 0.10 * (F.col("kind") == F.col("a_kind")).cast("double") + 0.10 * jaccard(F.col("deps"), F.col("a_deps"))
    rated = pair.withColumn("score", F.round(s, 6))
    return rated.groupBy("task").agg(F.min_by("atom", F.struct(-F.col("score"), F.col("atom"))).alias("atom"), F.max("score").alias("score"))


def span_support(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Whether any cited chunk holds the span, as it is or by letters and digits only: id, supported.

    Citations of a chunk that more than HOT answers cite are dealt to several tasks, each with the chunk's content.
    """
    cited = answers.select("id", "span", F.explode_outer("chunk_ids").alias("chunk_id"))
    # at most a row for every HOT citations
    hot = F.broadcast(cited.filter("chunk_id is not null").groupBy("chunk_id").agg(F.ceil(F.count("*") / HOT).cast("int").alias("shares")).filter("shares > 1"))
    shares = F.coalesce("shares", F.lit(1))
    # citations of none are dealt too: they meet nothing
    deal = F.when(F.col("chunk_id").isNull(), F.pmod(F.xxhash64("id"), F.lit(4096))).otherwise(F.pmod(F.xxhash64("id"), shares)).cast("int")
    dealt = cited.join(hot, "chunk_id", "left").select("id", "span", "chunk_id", deal.alias("share"))
    held = chunks.select("chunk_id", "content").join(hot, "chunk_id", "left").select("chunk_id", "content", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    both = dealt.join(held, ["chunk_id", "share"], "left")
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
    hit = F.contains(F.col("content"), F.col("span")) | F.contains(bare("content"), F.trim(bare("span")))
    return both.groupBy("id").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("supported"))
