"""Community reports from the deepest level up: a level's reports stand in for members that the next one has no room for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom import providers as P
from graphloom.functions import text as T
from graphloom.lineage import written
from graphloom.operators import communities as CO
from graphloom.operators import graph as G

#: fixed values: the tables' headers, in this order
HEADERS = {"Reports": ("id", "report", "rating", "importance"), "Entities": ("id", "entity", "type", "description", "degree"), "Relationships": ("id", "source", "target", "description", "rank")}
UNKNOWN = "UNKNOWN"
REPORT = "title string, summary string, rating double, findings array<struct<summary string, explanation string>>"


def _tokens(c: Column) -> Column:
    return F.size(T.words(F.coalesce(c, F.lit("")))).cast("long")


def _fits(rows: DataFrame, order: list[Column], tokens: Column, most: Column) -> DataFrame:
    """``rows`` with ``ok``: in the longest start of their cluster's list whose tokens sum to at most ``most``."""
    w = W.partitionBy("cluster").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("ok", F.sum(tokens).over(w) <= most)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))


def _table(name: str, rows: DataFrame, order: list[Column], fields: list[Column]) -> DataFrame:
    """cluster, <name>: the rows in order as quoted lines under the table's header."""
    numbered = rows.withColumn("_r", F.row_number().over(W.partitionBy("cluster").orderBy(*order)))
    line = F.concat_ws(",", *[_quoted(f) for f in fields])
    lines = numbered.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    header = ",".join(f'"{h}"' for h in HEADERS[name])
    return lines.select("cluster", F.array_join(F.concat(F.array(F.lit(header)), "lines"), "\n").alias(name))


def members(membership: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of (level, cluster) for nodes: id, node, type, description, degree; and for edges with an end in it: id, src, tgt, description, rank.

    ``id`` counts from 0 by name. Missing types and descriptions read UNKNOWN.
    """
    m = membership.select("level", "cluster", "node").distinct()
    text = lambda df, c: F.coalesce(F.col(c), F.lit(UNKNOWN)) if c in df.columns else F.lit(UNKNOWN)
    known = nodes.select(F.col("entity_name").alias("node"), text(nodes, "entity_type").alias("type"), text(nodes, "description").alias("description"))
    n = m.join(known, "node", "left").join(G.degree(edges), "node", "left").fillna(UNKNOWN, ["type", "description"]).fillna(0, ["degree"])
    place = lambda *by: (F.row_number().over(W.partitionBy("level", "cluster").orderBy(*by)) - 1).alias("id")
    n = n.select("level", "cluster", place("node"), "node", "type", "description", "degree")
    ranked = G.edge_degree(edges).select("src", "tgt", text(edges, "description").alias("description"), "rank")
    e = ranked.withColumn("node", F.explode(F.array("src", "tgt"))).join(m, "node").drop("node").groupBy("level", "cluster", "src", "tgt").agg(F.min("description").alias("description"), F.max("rank").alias("rank"))
    return n, e.select("level", "cluster", place(F.concat("src", "tgt"), "src"), "src", "tgt", "description", "rank")


def pack(nodes: DataFrame, edges: DataFrame, subs: DataFrame | None, inside_nodes: DataFrame | None, inside_edges: DataFrame | None, budget: int) -> DataFrame:
    """cluster, description of one level's clusters: its nodes by degree and its edges by rank, within half the ``budget`` of description words each.

    Where either doesn't fit and the cluster has reported inner clusters (``subs``: cluster, sub, report_string, rating, occurrence), their reports
    come first, by occurrence within the budget; what is left is halved again, and nodes and edges of the reports used (``inside_*``: cluster, sub and the
    node or src, tgt) come after all others.
    """
    by_degree, by_rank = [F.desc("degree"), F.col("id")], [F.desc("rank"), F.col("id")]
    size, half = _tokens(F.col("description")), F.lit(budget // 2)
    n, e = _fits(nodes, by_degree, size, half), _fits(edges, by_rank, size, half)
    n, e = n.withColumn("late", F.lit(False)), e.withColumn("late", F.lit(False))
    reports = None
    if subs is not None:
        cut_short = n.filter("not ok").select("cluster").union(e.filter("not ok").select("cluster")).distinct()
        used = _fits(subs.join(cut_short, "cluster", "left_semi"), [F.desc("occurrence"), F.col("sub")], _tokens(F.col("report_string")), F.lit(budget)).filter("ok")
        used = written(used.withColumn("id", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("occurrence"), "sub")) - 1).drop("ok"))
        reports = written(_table("Reports", used, [F.col("id")], [F.col("id"), F.col("report_string"), F.col("rating"), F.round("occurrence", 6)]))
        left = reports.select("cluster", F.floor((F.lit(budget) - _tokens(F.col("Reports"))) / 2).alias("room"))

        def again(rows: DataFrame, inside: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
            held = inside.join(used.select("cluster", "sub"), ["cluster", "sub"], "left_semi").select("cluster", *key, F.lit(True).alias("_in")).distinct()
            new = rows.drop("ok", "late").join(left, "cluster").join(held, ["cluster", *key], "left").withColumn("late", F.coalesce("_in", F.lit(False))).drop("_in")
            new = _fits(new, [F.col("late"), *order], size, F.col("room")).drop("room")
            return rows.join(left, "cluster", "left_anti").unionByName(new)

        n, e = again(n, inside_nodes, ["node"], by_degree), again(e, inside_edges, ["src", "tgt"], by_rank)
    n = _table("Entities", n.filter("ok"), [F.col("late"), *by_degree], [F.col(c) for c in ("id", "node", "type", "description", "degree")])
    e = _table("Relationships", e.filter("ok"), [F.col("late"), *by_rank], [F.col(c) for c in ("id", "src", "tgt", "description", "rank")])
    out = nodes.select("cluster").distinct().join(n, "cluster", "left").join(e, "cluster", "left")
    out = out.join(reports, "cluster", "left") if reports is not None else out.withColumn("Reports", F.lit(None).cast("string"))
    part = lambda name: F.concat(F.lit(f"-----{name}-----\n```csv\n"), F.coalesce(F.col(name), F.lit("")), F.lit("\n```"))
    return out.select("cluster", F.concat_ws("\n", *[part(name) for name in HEADERS]).alias("description"))


def reports_by_level(membership: DataFrame, nodes: DataFrame, edges: DataFrame, node_chunks: DataFrame, provider: P.LLMProvider | None = None, budget: int = 12000) -> DataFrame:
    """level, cluster, title, summary, rating, report_string, occurrence, n_subs of every cluster; the provider is asked once a cluster.

    Levels go from the deepest up, and a level's table of reports is read by the next. The prompt is 'report', the cluster and
    its description (see :func:`pack`), parted by tabs. An answer that isn't a JSON object of the known fields becomes the summary, with the title
    "Community Report" and rating -1. Clusters names are unique across levels. ``node_chunks``: entity_name, chunk_id.
    """
    shape = CO.schema(membership, edges, node_chunks).select("level", "cluster", "occurrence")
    shape, inner = written(shape), written(CO.inner_clusters(membership))
    n, e = (written(x) for x in members(membership, nodes, edges))
    done: DataFrame | None = None
    out = []
    for level in sorted((r["level"] for r in shape.select("level").distinct().collect()), reverse=True):
        own = inner.filter(F.col("level") == level).select("cluster", "sub")
        subs = inside_n = inside_e = None
        if done is not None:
            subs = own.join(done.select(F.col("cluster").alias("sub"), "report_string", "rating", "occurrence"), "sub")
            inside = lambda rows, *key: own.join(rows.filter(F.col("level") == level + 1).select(F.col("cluster").alias("sub"), *key), "sub")
            inside_n, inside_e = inside(n, "node"), inside(e, "src", "tgt")
        described = written(pack(n.filter(F.col("level") == level).drop("level"), e.filter(F.col("level") == level).drop("level"), subs, inside_n, inside_e, budget))
        asked = P.complete(described, F.concat_ws("\t", F.lit("report"), F.col("cluster"), F.col("description")), "answer", provider)
        j = F.from_json("answer", REPORT)
        parsed = asked.withColumn("j", F.when(F.coalesce(j["title"], j["summary"]).isNotNull(), j))
        found = parsed.select(
            "cluster", F.when(F.col("j").isNull(), F.lit("Community Report")).otherwise(F.coalesce("j.title", F.lit(""))).alias("title"), F.when(F.col("j").isNull(), F.coalesce("answer", F.lit(""))).otherwise(F.coalesce("j.summary", F.lit(""))).alias("summary"),
            F.coalesce("j.rating", F.lit(-1.0)).alias("rating"), F.coalesce("j.findings", F.array().cast("array<struct<summary string, explanation string>>")).alias("findings"))
        found = found.withColumn("report_string", CO.render_report(F.col("title"), F.col("summary"), F.col("findings"))).drop("findings")
        counts = own.groupBy("cluster").agg(F.count("*").alias("n_subs"))
        at = shape.filter(F.col("level") == level).join(found, "cluster").join(counts, "cluster", "left").fillna(0, ["n_subs"])
        done = written(at.select("level", "cluster", "title", "summary", "rating", "report_string", "occurrence", "n_subs"))
        out.append(done)
    if not out:
        return shape.selectExpr("level", "cluster", "'' AS title", "'' AS summary", "0D AS rating", "'' AS report_string", "occurrence", "0L AS n_subs")
    return reduce(DataFrame.unionByName, out)
