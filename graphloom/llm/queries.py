"""One query per training-data operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import secrets
from graphloom.llm.decontaminate import MASKS, WINDOW, contaminated
from graphloom.llm.fingerprints import compare_with_next
from graphloom.llm.html_text import extract
from graphloom.llm.jaccard_join import jaccard_classes
from graphloom.llm.line_dedup import DEPTH, LONG, MIN_DOCS, PAIR, dedup_lines
from graphloom.llm.pieces import tokenize
from graphloom.llm.quality import classify
from graphloom.llm.resample import resample
from graphloom.llm.runs import find_runs, run_digests
from graphloom.llm.sharding import shard_by_bytes
from graphloom.llm.token_counts import count_with_edits
from graphloom.llm.trie_dedup import exact_groups


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_findings(spark))
    return secrets.scan(_table(spark, sf_dir, "documents"), model)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_line_dedup_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), passage_docs=PAIR)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def edits() -> Column:
    """Three edits of each text: a replacement at a third, a cut at two thirds, an addition at the end."""
    n = F.coalesce(F.length("text"), F.lit(0))
    row = lambda start, end, put: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(put).alias("put"))
    third, cut = (n / 3).cast("int"), (2 * n / 3).cast("int")
    return F.array(row(third, third + 12, " edited passage, 1st "), row(cut, cut + 30, ""), row(n + 100, n + 100, " The end."))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_with_edits(_table(spark, sf_dir, "documents"), edits())


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(_table(spark, sf_dir, "documents"), shards=8)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), orders=1, buckets=10_000, percent=10, least_words=20, seed=2024)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"), keep="largest")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(find_runs(_table(spark, sf_dir, "documents"), least=24, power=3, plant=True))


#: name -> query
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_html_extraction": op3_html_extraction,
    "op4_line_dedup": op4_line_dedup,
    "op4_line_dedup_passages": op4_line_dedup_passages,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_sharding": op8_sharding,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"



def _kept(mask: str, words: str, at: str) -> str:
    return " || ' ' || ".join(f"{words}[{at} + {i}]" for i, c in enumerate(mask) if c == "1")


def _seeds(table: str, key: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, i AS at, {len(m)} AS span, '{m} ' || {_kept(m, 'words', 'i')} AS seed FROM (SELECT {key}, words, unnest(range(1, len(words) - {len(m) - 2})) AS i FROM {table})" for m in MASKS)


_PLAIN = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'))"

#: name -> SQL for DuckDB
SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i+3], ' '))) END AS s FROM w),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
          FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85 GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= 85 * (n + m - c)),
adj AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM adj UNION SELECT r.x, a.y FROM reach r JOIN adj a ON r.y = a.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CAST(coalesce(least(l.y, s.doc_id), s.doc_id) AS BIGINT) AS component_id
FROM sets s LEFT JOIN least_of l ON l.x = s.doc_id""",
    "op5_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, string_split({_PLAIN}, ' ') AS words FROM documents),
b AS (SELECT item_id, string_split({_PLAIN}, ' ') AS words FROM benchmark),
ds AS ({_seeds("d", "doc_id")}), bs AS ({_seeds("b", "item_id")}),
hits AS (SELECT DISTINCT ds.doc_id, bs.item_id, ds.at - 1 AS p, bs.at - 1 AS j, bs.span FROM ds JOIN bs USING (seed)),
w AS (SELECT h.doc_id, h.item_id, d.words AS x, b.words AS y, least({WINDOW}, len(b.words)) AS n, p, j,
      greatest(0, least(j + span // 2 - {WINDOW // 2}, len(b.words) - least({WINDOW}, len(b.words)))) AS a
      FROM hits h JOIN d USING (doc_id) JOIN b USING (item_id)),
m AS (SELECT doc_id, item_id, n, p - j + a AS start,
      len(list_filter(range(0, n), lambda i: p - j + a + i >= 0 AND coalesce(x[p - j + a + i + 1] = y[a + i + 1], false))) AS same FROM w)
SELECT doc_id, item_id, CAST(min(start) AS BIGINT) AS first_word, CAST(max(same) AS BIGINT) AS matched, CAST(max(n) AS BIGINT) AS "window",
       round(max(same) / max(n), 6) AS similarity
FROM m WHERE 5 * same >= 4 * n GROUP BY doc_id, item_id""",
    "op8_sharding": """
WITH crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(256) r(n)),
d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size,
      list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents),
c AS (SELECT doc_id, size, b, CAST(xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS BIGINT) AS text_crc32 FROM d, crc),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY b) AS first, sum(size) OVER () AS total FROM c),
o AS (SELECT *, row_number() OVER w AS place, row_number() OVER v AS top, coalesce(sum(size) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
      FROM g WINDOW w AS (ORDER BY first, doc_id, size, text_crc32), v AS (ORDER BY size DESC, first, doc_id, text_crc32)),
a AS (SELECT *, coalesce(bool_and(top < 8 AND size * (9 - top) > total - above) OVER (ORDER BY top), false) AS own FROM o),
n AS (SELECT *, 8 - count(*) FILTER (own) OVER () AS shares, greatest(total - coalesce(sum(size) FILTER (own) OVER (), 0), 1) AS rest,
      sum(CASE WHEN own THEN 0 ELSE size END) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto FROM a),
h AS (SELECT *, sum(size) OVER (PARTITION BY first, own) AS bytes, min(upto - size) OVER (PARTITION BY first, own) AS start FROM n),
s AS (SELECT *, CAST(CASE WHEN own THEN 8 - top WHEN 100 * bytes * shares <= rest THEN (2 * start + bytes) * shares // (2 * rest) ELSE (2 * upto - size) * shares // (2 * rest) END AS INTEGER) AS shard FROM h)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s""",
    "op4_line_dedup": rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
q AS (SELECT doc_id, pos, line, regexp_extract_all(line, '\S+') AS t FROM l),
k AS (SELECT doc_id, pos, line, CASE WHEN 7 * len(list_filter(t, lambda x: x = '<*>' OR regexp_matches(x, '[0-9]'))) <= 3 * len(list_filter(t, lambda x: regexp_matches(x, '\p{{L}}') AND NOT regexp_matches(x, '[0-9]'))) THEN list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) ELSE t END AS t FROM q),
c AS (SELECT doc_id, pos, line, array_to_string(t, ' ') AS whole, len(t) || ' ' || array_to_string(t[1:{DEPTH}], ' ') AS leaf, t[{DEPTH} + 1:] AS cells FROM k WHERE len(t) > 0),
d AS (SELECT leaf, whole, count(DISTINCT doc_id) AS docs, min(doc_id) AS first,
      any_value(cells) AS cells FROM c GROUP BY leaf, whole),
v AS (SELECT leaf FROM d GROUP BY leaf HAVING count(*) > 1 AND sum(docs) >= {MIN_DOCS}),
e AS (SELECT leaf, whole, docs, unnest(cells) AS token, generate_subscripts(cells, 1) AS place FROM d SEMI JOIN v USING (leaf)),
f AS (SELECT leaf, place, token FROM e GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}),
s AS (SELECT leaf, whole, leaf || ' / ' || string_agg(place || ':' || f.token, ' / ' ORDER BY place) AS template FROM e LEFT JOIN f USING (leaf, place, token)
      GROUP BY leaf, whole HAVING 10 * count(f.token) FILTER (e.token <> '<*>') >= 7 * count(*)),
u AS (SELECT d.leaf, d.whole, coalesce(s.template, d.leaf || ' // ' || d.whole) AS template, d.first FROM d LEFT JOIN s USING (leaf, whole)),
r AS (SELECT u.template, count(DISTINCT c.doc_id) AS docs, min(u.first) AS keep FROM u JOIN c USING (leaf, whole) GROUP BY u.template HAVING count(DISTINCT c.doc_id) >= {MIN_DOCS}),
g AS (SELECT DISTINCT c.doc_id, c.pos FROM c JOIN u USING (leaf, whole) JOIN r USING (template) WHERE c.doc_id <> r.keep),
a AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS kept
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(a.kept, '') END AS text, coalesce(a.n_lines, 0) AS n_lines, coalesce(a.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN a USING (doc_id)""",
}

_G = "g AS (SELECT DISTINCT c.doc_id, c.pos FROM c JOIN u USING (leaf, whole) JOIN r USING (template) WHERE c.doc_id <> r.keep)"
assert _G in SQL["op4_line_dedup"]
SQL["op4_line_dedup_passages"] = SQL["op4_line_dedup"].replace(_G, f"""
p AS (SELECT leaf, whole, keep FROM u JOIN r USING (template) UNION ALL SELECT leaf, whole, u.first FROM u JOIN d USING (leaf, whole) ANTI JOIN r USING (template)
      WHERE d.docs >= {PAIR} AND CAST(split_part(leaf, ' ', 1) AS INTEGER) > {LONG}),
g AS (SELECT DISTINCT c.doc_id, c.pos FROM c JOIN p USING (leaf, whole) WHERE c.doc_id <> p.keep)""")

_RUNS_OF_LETTERS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op11_importance_resampling"] = f"""
WITH crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(256) r(n)),
d AS (SELECT doc_id, {_RUNS_OF_LETTERS} AS words FROM documents),
b AS (SELECT unnest({_RUNS_OF_LETTERS}) AS word FROM benchmark),
e AS (SELECT doc_id, unnest(words) AS word FROM d),
v AS (SELECT DISTINCT word FROM (SELECT word FROM e UNION ALL SELECT word FROM b)),
h AS (SELECT word, list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM v),
k AS (SELECT word, CAST(xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS BIGINT) AS bucket FROM h, crc),
s AS (SELECT bucket, count(*) AS s FROM e JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (word) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM e) AS s_all, (SELECT count(*) FROM b) AS t_all),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain
      FROM s FULL JOIN t USING (bucket), n),
w AS (SELECT d.doc_id, count(e.word) AS n_features, CAST(coalesce(sum(g.gain), 0) AS BIGINT) AS weight FROM d LEFT JOIN e USING (doc_id) LEFT JOIN k USING (word) LEFT JOIN g USING (bucket) GROUP BY d.doc_id),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM w),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_features >= 20)
SELECT z.doc_id, n_features, weight, score, r.rank FROM z LEFT JOIN (SELECT * FROM r WHERE rank <= (SELECT count(*) FROM r) * 10 // 100) r USING (doc_id)"""

SQL["op12_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, row_number() OVER (same ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
