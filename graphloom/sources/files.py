"""Readers of corpora and question sets, writers of graphs, chunks and results."""

from __future__ import annotations

import os
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.lineage import cut

# Column names tried, in this order, and names that wrap a list of records.
TEXT_NAMES = ("content", "context", "text", "body", "message", "description", "tweet", "post", "abstract", "summary")
TITLE_NAMES = ("title", "name", "subject", "headline", "author", "id")
WRAPPERS = ("results", "data", "items", "records", "documents", "entries", "rows")
DOCUMENT = "title string, content string, metadata map<string,string>"


def find_column(columns: list[str], names: tuple[str, ...]) -> str | None:
    low = {c.lower(): c for c in columns}
    return next((low[n] for n in names if n in low), None)


def records(df: DataFrame, stem: str) -> DataFrame:
    """Rows to (title, content, metadata): text and title columns by name; blank contents go; other columns become metadata."""
    text, title = find_column(df.columns, TEXT_NAMES), find_column(df.columns, TITLE_NAMES)
    if text is None:
        raise ValueError(f"no text column among {df.columns}")
    rest = [c for c in df.columns if c not in (text, title)]
    meta = F.map_filter(F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in rest])), lambda k, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    named = F.col(title).cast("string") if title else F.lit(None).cast("string")
    fallback = F.concat_ws("_", F.lit(stem), F.monotonically_increasing_id().cast("string"))
    return df.filter(F.trim(F.col(text).cast("string")) != "").select(F.coalesce(named, fallback).alias("title"), F.col(text).cast("string").alias("content"), meta.alias("metadata"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Each file is a document titled by its name."""
    df = spark.read.text(path, wholetext=True)
    title = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return df.filter(F.trim("value") != "").select(title.alias("title"), F.col("value").alias("content"), F.create_map().cast("map<string,string>").alias("metadata"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array, an object that wraps one, or a single object."""
    df = spark.read.option("multiLine", True).json(path)
    lists = [c for c, t in df.dtypes if t.startswith("array<struct")]
    wrapped = next((c for c in WRAPPERS if c in lists), lists[0] if len(lists) == 1 and len(df.columns) == 1 else None)
    if wrapped:
        df = df.select(F.explode(wrapped).alias("r")).select("r.*")
    return records(df, _stem(path))


def read_jsonl(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Lines of JSON; a bad line raises, or is left out if not ``strict``."""
    return records(spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path), _stem(path))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return records(spark.read.csv(path, header=True, multiLine=True, escape='"'), _stem(path))


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """Pages joined by blank lines; needs pypdf on the executors."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise ValueError("reading PDF needs pypdf") from e

    def pages(batches):
        import io

        import pandas as pd
        import pypdf

        for b in batches:
            yield pd.DataFrame({"title": [os.path.splitext(os.path.basename(p))[0] for p in b["path"]], "content": ["\n\n".join(x.extract_text() or "" for x in pypdf.PdfReader(io.BytesIO(c)).pages) for c in b["content"]]})

    df = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(pages, "title string, content string")
    return df.filter(F.trim("content") != "").withColumn("metadata", F.create_map().cast("map<string,string>"))


READERS = {".txt": read_text, ".md": read_text, ".json": read_json, ".jsonl": read_jsonl, ".csv": read_csv, ".pdf": read_pdf}


def _stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path.rstrip("/")))[0].replace("*", "all")


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """title, content, metadata by the path's extension; an unknown one raises."""
    ext = os.path.splitext(path)[1].lower()
    if ext not in READERS:
        raise ValueError(f"no reader for {ext or path}")
    return READERS[ext](spark, path)


def numbered(docs: DataFrame) -> DataFrame:
    """Sequential doc_id in the order of (title, content), by offsets of ranges: no table-wide sort in one task."""
    ranged = cut(docs.repartitionByRange("title", "content").withColumn("_p", F.spark_partition_id()))
    n = ranged.groupBy("_p").agg(F.count("*").alias("n"))
    before = n.select("_p", F.coalesce(F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    at = F.row_number().over(W.partitionBy("_p").orderBy("title", "content")) - 1
    return ranged.join(F.broadcast(before), "_p").withColumn("doc_id", F.col("_b") + at).drop("_p", "_b")


def prepare_corpus(spark: SparkSession, folder: str, out: str | None = None) -> DataFrame:
    """All readable files of a folder as one numbered corpus, by extension and name; what can't be read is left out. Written as JSON lines to ``out``."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    paths = sorted((os.path.splitext(p)[1], p) for p in (str(s.getPath().toString()) for s in fs.listStatus(fs_path)))
    found = None
    for ext, p in paths:
        if ext.lower() not in READERS:
            continue
        try:
            one = read_file(spark, p)
        except (AnalysisException, ValueError) as e:  # one bad file doesn't stop the rest, and is told
            warnings.warn(f"{p} is left out: {e}", stacklevel=2)
            continue
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError(f"nothing to read in {folder}")
    docs = numbered(found)
    if out:
        docs.write.mode("overwrite").json(out)
    return docs


def pages_corpus(pages: DataFrame) -> DataFrame:
    """Pages to (doc_id, title, content): the title element, tags stripped, blank contents left out."""
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    body = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style|title)[^>]*>.*?</(script|style|title)>", " "), "<[^>]*>", " ")
    return pages.select(F.col("page_id").alias("doc_id"), title.alias("title"), F.trim(F.regexp_replace(body, "[ \t\n\r]+", " ")).alias("content")).filter("content <> ''")


def questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A question set in JSON lines: question, answer (null where absent), id and the other columns."""
    q = spark.read.json(path)
    for c in ("id", "answer"):
        if c not in q.columns:
            q = q.withColumn(c, F.monotonically_increasing_id().cast("string") if c == "id" else F.lit(None).cast("string"))
    return q.limit(limit) if limit is not None else q


def convert_benchmark(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, corpus) of rows id, question, answer, context (array of struct title, text): equal passages once."""
    corpus = items.select(F.explode("context").alias("c")).select(F.col("c.title").alias("title"), F.col("c.text").alias("content")).distinct()
    return items.select("id", "question", "answer"), corpus


# sinks


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, force: bool = False) -> None:
    """Parquet nodes and edges; an existing graph stays unless forced."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite" if force else "ignore").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(path)


def write_tree(tree: DataFrame, path: str) -> None:
    """A folder per layer, so leaves can be kept while upper layers are rebuilt."""
    tree.write.mode("overwrite").partitionBy("layer").parquet(path)


def write_results(predictions: DataFrame, metrics: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").json(f"{path}/results")
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")


def as_json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def sample_graph(nodes: DataFrame, edges: DataFrame, n: int, m: int) -> tuple[DataFrame, DataFrame]:
    """The first n nodes by name and the first m edges among them."""
    few = nodes.orderBy("entity_name").limit(n)
    e = edges.join(few.select(F.col("entity_name").alias("src")), "src", "left_semi").join(few.select(F.col("entity_name").alias("tgt")), "tgt", "left_semi")
    return few, e.select(*edges.columns).orderBy("src", "tgt").limit(m)


def export_graph(nodes: DataFrame, edges: DataFrame, n: int = 1000, m: int = 5000) -> DataFrame:
    """One JSON text of a sample, as it is one row: at most n nodes, m edges among them, and their counts. ``gml_lines`` writes a whole graph."""
    a, b = sample_graph(nodes, edges, n, m)
    x = a.agg(F.sort_array(F.collect_list(F.struct(*nodes.columns))).alias("nodes"))
    y = b.agg(F.sort_array(F.collect_list(F.struct(*edges.columns))).alias("edges"))
    meta = F.struct(F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"))
    return x.crossJoin(y).select(F.to_json(F.struct("nodes", "edges", meta.alias("metadata"))).alias("graph"))


def gml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GML text, a line per row with its order: write with ``orderBy('part', 'key')``."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit("&quot;")), F.lit('"'))
    a = nodes.select(F.lit(1).alias("part"), F.col("entity_name").alias("key"), F.concat(F.lit("  node [ label "), q("entity_name"), F.lit(" type "), q("entity_type"), F.lit(" ]")).alias("line"))
    b = edges.select(F.lit(2).alias("part"), F.concat_ws("|", "src", "tgt").alias("key"), F.concat(F.lit("  edge [ source "), q("src"), F.lit(" target "), q("tgt"), F.lit(" weight "), F.col("weight").cast("string"), F.lit(" ]")).alias("line"))
    ends = nodes.sparkSession.createDataFrame([(0, "", "graph ["), (3, "", "]")], "part int, key string, line string")
    return a.unionByName(b).unionByName(ends)


def json_field(c: Column, path: str) -> Column:
    """A field of JSON in free text: inside a fence, the outermost braces, else a 'key: value' line."""
    from graphloom.functions.text import unfence

    span = F.regexp_extract(unfence(c), r"(?s)([\[{].*[\]}])", 1)
    key = path.split(".")[-1]
    loose = F.nullif(F.regexp_extract(c, rf"(?m)[\"']?{key}[\"']?\s*[:=]\s*[\"']?([^\"'\n,}}]+)", 1), F.lit(""))
    return F.coalesce(F.get_json_object(span, path), F.trim(loose))
