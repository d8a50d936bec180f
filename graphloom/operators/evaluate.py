"""Answer quality and run metrics over prediction rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions.alignment import lcs_length


def bind(f, *values: Column) -> Column:
    """f of the values, each evaluated once: lambdas would evaluate an expression again for every item."""
    held = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.transform(held, lambda s: f(*[s[f"v{i}"] for i in range(len(values))]))[0]


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return bind(lambda a, b: F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x))), a, b)


def passages_held(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", run: int = 8) -> DataFrame:
    """(item, document) wherever a document holds ``run`` consecutive words of an item, or all words of a shorter one.

    Whole texts are read; words are runs of letters and digits in lower case. Nulls and texts without words hold nothing.
    """
    plain = lambda rows, key: rows.select(key, F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")).alias("plain")).filter("plain <> ''")
    d, i = plain(docs, doc_id), plain(items, item_id)
    words = F.split("plain", " ")

    def runs(rows, key):
        w = rows.select(key, words.alias("w")).filter(F.size("w") >= run)
        return w.select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - run), lambda at: F.array_join(F.slice("w", at + 1, run), " ")))).alias("run"))

    padded = F.concat(F.lit(" "), "plain", F.lit(" "))
    short = i.filter(F.size(words) < run).select(item_id, padded.alias("all"))
    few = d.select(doc_id, padded.alias("within")).join(short, F.contains(F.col("within"), F.col("all"))).select(item_id, doc_id)
    return runs(d, doc_id).join(runs(i, item_id), "run").select(item_id, doc_id).unionByName(few).distinct()


def answer_scores(pred: Column, gold: Column, special: bool = True) -> Column:
    """Struct of em, f1, precision, recall and accuracy (gold inside prediction).

    With ``special`` a yes, no or noanswer on either side that differs from the other scores 0.
    """

    def scores(p, g, a, b, same):
        odd = (p.isin("yes", "no", "noanswer") | g.isin("yes", "no", "noanswer")) & (p != g) if special else F.lit(False)
        none = odd | (same == 0)
        precision, recall = same / F.size(a), same / F.size(b)
        z = lambda c: F.when(none, 0.0).otherwise(F.round(c, 6))
        return F.struct((p == g).cast("double").alias("em"), z(2 * precision * recall / (precision + recall)).alias("f1"), z(precision).alias("precision"), z(recall).alias("recall"), F.contains(p, g).cast("double").alias("accuracy"))

    return bind(lambda p, g: bind(lambda p, g, a, b: bind(scores, p, g, a, b, overlap(a, b)), p, g, T.words(p), T.words(g)), T.answer(pred), T.answer(gold))


def short_form(rows: DataFrame) -> DataFrame:
    """Mean scores x 100 of (predicted, gold), with bars and line ends as spaces."""
    flat = lambda c: F.regexp_replace(c, r"[|\n]", " ")
    s = rows.select(answer_scores(flat("predicted"), flat("gold")).alias("s"))
    return s.agg(*[F.round(100 * F.avg(f"s.{c}"), 4).alias(c) for c in ("em", "f1", "precision", "recall", "accuracy")], F.count("*").alias("n"))


def bleu(pred: Column, gold: Column, order: int = 1, smooth: bool = False) -> Column:
    """BLEU with clipped n-gram precision up to ``order`` and the brevity penalty; ``smooth`` adds one beyond unigrams."""

    def score(a, b):
        logs, zero = F.lit(0.0), F.lit(False)
        for n in range(1, order + 1):
            add = 1.0 if smooth and n > 1 else 0.0
            top, bottom = overlap(T.ngrams(a, n), T.ngrams(b, n)) + add, F.greatest(F.lit(0), F.size(a) - n + 1) + add
            zero = zero | (top == 0) | (bottom == 0)
            logs = logs + F.log(F.when(top > 0, top).otherwise(1.0) / F.when(bottom > 0, bottom).otherwise(1.0)) / order
        penalty = F.when(F.size(a) >= F.size(b), 1.0).otherwise(F.exp(1 - F.size(b) / F.greatest(F.size(a), F.lit(1))))
        return F.when(zero, 0.0).otherwise(F.round(penalty * F.exp(logs), 6))

    return bind(score, T.words(F.lower(pred)), T.words(F.lower(gold)))


def rouge_l(rows: DataFrame, pred: str = "predicted", gold: str = "gold") -> DataFrame:
    """Adds rouge_l, the F measure of the longest common word subsequence."""

    @F.pandas_udf("double")
    def lcs(a, b):
        import pandas as pd

        out = []
        for x, y in zip(a, b, strict=True):
            x, y = (x or "").lower().split(), (y or "").lower().split()
            n = lcs_length(x, y)
            out.append(round(2 * n / (len(x) + len(y)), 6) if n else 0.0)
        return pd.Series(out)

    return rows.withColumn("rouge_l", lcs(pred, gold))


def string_hits(text: Column, groups: Column) -> Column:
    """Struct of str_em, the share of groups (arrays of short answers) with any answer in the text, and str_hit, whether all have."""
    hit = bind(lambda t: F.transform(groups, lambda g: F.exists(g, lambda a: F.contains(t, T.answer(a))).cast("double")), T.answer(text))
    share = F.aggregate(hit, F.lit(0.0), lambda s, x: s + x) / F.size(groups)
    return bind(lambda x: F.struct(F.round(x, 6).alias("str_em"), (x == 1).cast("double").alias("str_hit")), share)


def option_of(text: Column) -> Column:
    """The option letter an answer names: 'B', '(B)', 'B.' or 'answer is B'."""
    return F.upper(F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)(?:answer is|answer:)\s*\(?([a-e])\b", 1), F.lit("")), F.regexp_extract(text, r"^\s*\(?([A-Ea-e])(?:[).:\s]|$)", 1)))


def by_method(rows: DataFrame, *keys: str) -> DataFrame:
    """Averages per method: em, f1, latency, calls, tokens, calls per question."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg("em"), 6).alias("em"), F.round(F.avg("f1"), 6).alias("f1"), F.round(F.avg("latency_s"), 6).alias("latency_s"), F.sum("n_llm_calls").alias("n_llm_calls"),
        F.sum(F.col("total_input_tokens") + F.col("total_output_tokens")).alias("tokens"), F.round(F.sum("n_llm_calls") / F.count("*"), 6).alias("calls_per_question"))


def failing(rows: DataFrame, metric: str, threshold: float | None = None) -> DataFrame:
    """Ids whose metric is null or under the threshold (0.5; for f1 0.999999)."""
    t = threshold if threshold is not None else 0.999999 if metric == "f1" else 0.5
    return rows.filter(F.col(metric).isNull() | (F.col(metric) < t)).select("id", metric)


def tool_errors(calls: DataFrame) -> DataFrame:
    """Per tool: calls, errors, coercions and status; by errors falling, then name."""
    g = calls.groupBy("tool").agg(F.count("*").alias("n_calls"), F.count("error").alias("n_errors"), F.sum("n_arg_coercions").alias("n_coercions"))
    status = F.when(F.col("n_errors") == F.col("n_calls"), "broken").when((F.col("n_errors") > 0) | (F.col("n_coercions") > 0), "degraded").otherwise("ok")
    return g.withColumn("status", status).orderBy(F.desc("n_errors"), "tool")


def verdict(text: Column) -> Column:
    """Whether a judge's answer says correct: its JSON field, fenced or not, else its words; a negative word wins. Null if it says neither."""
    span = F.regexp_extract(T.unfence(text), r"(?s)(\{.*\})", 1)
    field = F.lower(F.coalesce(F.get_json_object(span, "$.correct"), F.get_json_object(span, "$.verdict"), F.get_json_object(span, "$.is_correct")))
    low = F.lower(text)
    negative = low.rlike(r"\b(incorrect|not correct|wrong|false|no)\b")
    return F.when(field.isin("true", "correct", "yes", "1"), True).when(field.isin("false", "incorrect", "no", "0"), False).when(negative, False).when(low.rlike(r"\b(correct|true|yes)\b"), True)


def gate(metrics: DataFrame, at_least: dict[str, float], at_most: dict[str, float]) -> DataFrame:
    """One row: each bound's outcome and ``passed``."""
    cols = {f"{k}_ok": F.col(k) >= v for k, v in at_least.items()} | {f"{k}_ok": F.col(k) <= v for k, v in at_most.items()}
    out = metrics.withColumns(cols)
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.coalesce(F.col(c), F.lit(False))
    return out.withColumn("passed", ok)


def run_stats(rows: DataFrame, key: str, value: str, error: Column, hit: Column) -> DataFrame:
    """Per key: n, mean, min, max, sample std, hit and error rates of runs."""
    return rows.groupBy(key).agg(
        F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("std"),
        F.round(F.avg(hit.cast("double")), 6).alias("hit_rate"), F.round(F.avg(error.cast("double")), 6).alias("error_rate"))


def agent_runs(rows: DataFrame) -> DataFrame:
    """One row over questions: counts, and em and f1 over all and over those without an error."""
    fine = F.col("error").isNull()
    return rows.agg(
        F.count("*").alias("n"), F.count_if(~fine).alias("n_errors"), F.sum("n_llm_calls").alias("n_calls"), F.round(F.avg("latency_s"), 6).alias("latency_s"), F.round(F.avg("em"), 6).alias("em"), F.round(F.avg("f1"), 6).alias("f1"),
        F.round(F.avg(F.when(fine, F.col("em"))), 6).alias("em_completed"), F.round(F.avg(F.when(fine, F.col("f1"))), 6).alias("f1_completed"))
