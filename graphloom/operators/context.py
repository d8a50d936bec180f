"""Contexts for prompts: tables of rows within budgets that carry over, two contexts merged by rows, and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: fixed values: headings, fences and separators of a context's text
SECTIONS = {"entities": ("\n## Entities", "\n#Entities: None\n"), "relationships": ("\n## Relationships", "\n## Relationships: None\n"), "chunks": ("\n## Sources\n", "\n## Sources: None\n")}
OPEN, CLOSE = "```csv", "```"
FIELD, FIELD_ESCAPE, REFERENCE_END = "\t", "    ", "\n=====\n\n"


def csv_row(*fields: Column) -> Column:
    """Fields joined by tabs; tabs within them become spaces."""
    return F.concat_ws(FIELD, *[F.replace(F.coalesce(f.cast("string"), F.lit("None")), F.lit(FIELD), F.lit(FIELD_ESCAPE)) for f in fields])


def reference_row(place: Column, text: Column) -> Column:
    """A source with its number, from 1."""
    return F.concat(F.lit("["), place.cast("string"), F.lit("]  "), text, F.lit(REFERENCE_END))


def _fill(lengths: Column, rest: Column, own: Column) -> Column:
    """How far a table's rows fit, one after another: out of what earlier tables left over, else out of its own budget. n, rest, own."""
    start = F.struct(F.lit(0).alias("n"), rest.cast("long").alias("rest"), own.cast("long").alias("own"), F.lit(True).alias("open"))

    def step(s: Column, x: Column) -> Column:
        state = lambda n, rest, own, open_: F.struct(n.alias("n"), rest.alias("rest"), own.alias("own"), F.lit(open_).alias("open"))
        return (
            F.when(~s["open"], s).when(x <= s["rest"], state(s["n"] + 1, s["rest"] - x, s["own"], True)).when(x <= s["own"], state(s["n"] + 1, s["rest"], s["own"] - x, True))
            .otherwise(state(s["n"], s["rest"], s["own"], False)))

    return F.aggregate(lengths, start, step)


def assemble(rows: DataFrame, budgets: DataFrame, tables: tuple[str, ...] = tuple(SECTIONS), by: str = "question") -> DataFrame:
    """The rows of each question's context: those of ``rows`` (by, table, place, item) that fit, in all their columns.

    ``budgets`` (by, one column a table) are characters; a row takes its length and one for its line's end. Tables are filled in the given order:
    a row is paid from what the tables before it left over, if it fits there, else from its own table's budget; at the first row that
    fits neither the table stops, and what is left of its budget is carried over. A second pass spends what is left at the end; a third
    would add nothing, as no table's next row fit a larger rest. Rows of equal place go by item; null items count as empty; tables not named
    and questions without budgets have no rows; null budgets are 0.

    Rows beyond the sum of all budgets, by running sums over (table, place), can't fit and are left out before a question's lengths are gathered,
    so what is gathered is bounded by the budgets.
    """
    total = sum((F.greatest(F.coalesce(F.col(t), F.lit(0)), F.lit(0)) for t in tables), F.lit(0)).cast("long")
    budget = budgets.select(F.col(by), *[F.greatest(F.coalesce(F.col(t), F.lit(0)), F.lit(0)).cast("long").alias(f"_b_{t}") for t in tables], total.alias("_total"))
    order = W.partitionBy(by, "table").orderBy("place", "item")
    size = F.length(F.coalesce("item", F.lit(""))).cast("long") + 1
    known = rows.filter(F.col("table").isin(*tables)).join(budget.select(by, "_total"), by)
    near = known.withColumns({"_size": size, "_row": F.row_number().over(order), "_upto": F.sum(size).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))}).filter("_upto <= _total")
    lengths = near.groupBy(by).pivot("table", list(tables)).agg(F.transform(F.array_sort(F.collect_list(F.struct("_row", "_size"))), lambda x: x["_size"]))
    at, rest = budget.join(lengths, by), F.lit(0).cast("long")
    for t in tables:
        at = at.withColumn(f"_s_{t}", _fill(F.coalesce(t, F.array().cast("array<bigint>")), rest, F.col(f"_b_{t}")))
        rest = F.col(f"_s_{t}")["rest"] + F.col(f"_s_{t}")["own"]
    for t in tables:
        left = F.coalesce(F.expr(f"slice(`{t}`, _s_{t}.n + 1, greatest(size(`{t}`), 1))"), F.array().cast("array<bigint>"))
        at = at.withColumn(f"_t_{t}", _fill(left, rest, F.lit(0)))
        rest = F.col(f"_t_{t}")["rest"]
    counts = at.select(by, F.explode(F.array(*[F.struct(F.lit(t).alias("table"), (F.col(f"_s_{t}")["n"] + F.col(f"_t_{t}")["n"]).alias("_n")) for t in tables])).alias("x")).select(by, "x.*")
    return near.join(counts, [by, "table"]).filter("_row <= _n").select(*rows.columns)


def render(kept: DataFrame, questions: DataFrame, by: str = "question") -> DataFrame:
    """by, context: the text of each question's tables, a note in place of one without rows."""
    lines = kept.groupBy(by).pivot("table", list(SECTIONS)).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]))
    parts = []
    for t, (heading, none) in SECTIONS.items():
        inner = F.concat(F.array(F.lit(heading), F.lit(OPEN)), F.col(t), F.array(F.lit(CLOSE))) if t != "chunks" else F.concat(F.array(F.lit(heading)), F.col(t))
        parts.append(F.when(F.coalesce(F.size(t), F.lit(0)) > 0, inner).otherwise(F.array(F.lit(none))))
    return questions.select(by).distinct().join(lines, by, "left").select(by, F.array_join(F.concat(*parts), "\n").alias("context"))


def merge_contexts(high: DataFrame, low: DataFrame, by: str = "question") -> DataFrame:
    """by, n, item: the rows of two tables (by, place, item) as one, those of ``high`` first, repeats left out, numbered from 1 again.

    Null and empty items are left out; ``item`` is a row without its number and header.
    """
    both = high.select(by, F.lit(0).alias("side"), "place", "item").unionByName(low.select(by, F.lit(1).alias("side"), "place", "item")).filter("item <> ''")
    one = both.groupBy(by, "item").agg(F.min(F.struct("side", "place")).alias("at"))
    return one.select(by, F.row_number().over(W.partitionBy(by).orderBy("at", "item")).cast("long").alias("n"), "item")


def merged_text(merged: DataFrame, header: str, by: str = "question") -> DataFrame:
    """by, text: the header's line and a numbered line for each row of :func:`merge_contexts`."""
    line = F.concat(F.col("n").cast("string"), F.lit(",\t"), F.col("item"))
    rows = merged.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    return rows.select(by, F.array_join(F.concat(F.array(F.lit(header.replace(",", ",\t"))), "lines"), "\n").alias("text"))


def truncate_tokens(rows: DataFrame, tokens: Column, order: list[Column], most: int, by: str) -> DataFrame:
    """The longest start of each group whose tokens sum to at most ``most``; the row that passes it ends the list."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("_sum", F.sum(tokens).over(w)).filter(F.col("_sum") <= most).drop("_sum")
