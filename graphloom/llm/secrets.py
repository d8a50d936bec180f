"""Secret scan: candidates by shape, false positives removed by a random forest. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TREES, DEPTH, SEED = 24, 7, 11
LEAST = 16  # characters of a run; near a telling name 8, and a value given to one may have any
THRESHOLD = 0.5
OPEN, CLOSE = "\x01", "\x02"

# Words by what they say of a value next to them, common words and letter pairs.
TELLING = "token|secret|password|passwd|pwd|passphrase|apikey|api_key|access_key|private_key|secret_key|client_secret|auth|authorization|bearer|credential|credentials"
# A telling name with its sign, and that with its value: quoted, or up to the next space. Authors, tokenizers and secretaries tell nothing.
NAME = rf"(?i:{TELLING})(?!(?i:(?<=auth)or(?!iz)|(?<=token)i[sz]|(?<=secret)a))[A-Za-z0-9_.\-]*+[\"'`\]]{{0,2}}[ \t]*+(?:=>|:=|==?|:)[ \t]*+"
VALUE = "(?:" + "|".join(rf"{q}[^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+{q}" for q in "\"'`") + r"|\S++)"
ASSIGNED = NAME + VALUE
HARMLESS = "sha|sha1|sha256|md5|commit|checksum|hash|digest|revision|integrity|etag|uuid|guid|id|build|version|tree|parent|blob|example|sample|dummy|isbn|phone|tel|card|order|invoice"
TEST_PATH = "test|tests|spec|example|examples|sample|samples|fixture|fixtures|mock|mocks|doc|docs|vendor|node_modules|lock"
CONFIG_PATH = "env|conf|config|settings|credentials|secrets|pem|key|yaml|yml|ini|properties"
DICTIONARY = (
    "account|address|access|admin|alpha|application|article|background|banner|beta|blue|book|button|cache|cafe|change|changeme|city|class|client|color|comment|"
    "common|content|country|create|data|date|default|demo|description|document|dummy|email|english|example|feature|field|file|final|first|font|form|foo|foobar|"
    "general|green|group|header|home|house|icon|image|index|info|insert|item|label|language|large|last|layout|letter|level|light|line|link|list|local|main|"
    "message|model|module|month|name|number|object|order|package|page|part|password|path|people|photo|place|placeholder|point|post|price|product|profile|project|public|"
    "question|read|record|release|report|request|response|result|sample|school|screen|search|secret|section|service|shop|simple|size|small|sound|source|state|station|"
    "story|street|string|style|summer|system|table|template|test|text|theme|thing|time|title|token|update|user|value|version|video|view|water|week|white|window|"
    "winter|word|work|world|write|year|your")
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur"

FEATURES = ("length", "changes", "digits", "uppers", "hex", "variety", "pairs", "dictionary", "telling", "harmless", "assigned", "quoted", "test_path", "config_path", "separators")


def _share(token: Column, pattern: str) -> Column:
    """Share of the token's characters that the pattern matches."""
    return 1 - F.length(F.regexp_replace(token, pattern, "")) / F.greatest(F.length(token), F.lit(1))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def with_features(found: DataFrame) -> DataFrame:
    """Adds FEATURES to rows of (token, before, within, after, path): the candidate, text on its left, its whole word, text on its right, its path."""
    t, low = F.col("token"), F.lower("token")
    n = F.greatest(F.length(t), F.lit(1))
    letters = F.split(t, "")
    near = F.lower(F.concat_ws(" ", "before", F.expr("substring_index(within, token, 1)")))
    named = lambda words: near.rlike(rf"(?:^|[^a-z0-9])[a-z0-9_.\-]*(?:{words})[a-z0-9_]*[^a-z0-9]*(?:[=:][^a-z0-9]*)?$")
    # the word that names the value: the last one before it
    return found.withColumns({
        "length": n.cast("double"),
        "changes": F.greatest(F.regexp_count(t, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")) - 1, F.lit(0)) / n,
        "digits": _share(t, "[0-9]"), "uppers": _share(t, "[A-Z]"), "hex": _share(low, "[0-9a-f]"),
        "variety": F.size(F.array_distinct(letters)) / n,
        "pairs": F.regexp_count(low, F.lit(f"(?={'|'.join(PAIRS.split())})")) / n,
        "dictionary": _share(low, DICTIONARY),
        "telling": _flag(named(TELLING)), "harmless": _flag(named(HARMLESS)),
        "assigned": _flag(near.rlike(r"[=:]\s*[\"']?$")), "quoted": _flag(F.col("within").rlike("[\"'`]") | F.col("before").rlike("[\"'`]$")),
        "test_path": _flag(F.lower("path").rlike(rf"(?:^|[^a-z])(?:{TEST_PATH})(?:[^a-z]|$)")),
        "config_path": _flag(F.lower("path").rlike(rf"(?:^|[^a-z])(?:{CONFIG_PATH})(?:[^a-z]|$)")),
        "separators": _share(t, r"[_/+.\-]"),
    })


def labelled_findings(spark: SparkSession, rows: int = 3000) -> DataFrame:
    """A table of labelled findings made by rule from hashes of the row number: token, before, within, after, path, label.

    Label 1: hexadecimal and base-64 credentials, prefixed keys, signed tokens, passwords and passphrases where they are
    assigned or passed. Label 0: commits, checksums, identifiers, numbers, file, host and word-like names, placeholders, references, words.
    """
    h = F.sha2(F.col("id").cast("string"), 256)
    b = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 512))), "[+/=]", "")
    words = F.array(*[F.lit(w) for w in DICTIONARY.split("|")])
    word = lambda i: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(i)), F.size(words)) + 1).cast("int"))
    pick = lambda i, *of: F.element_at(F.array(*[F.lit(x) for x in of]), (F.pmod(F.xxhash64("id", F.lit(100 + i)), F.lit(len(of))) + 1).cast("int"))
    digits = F.regexp_replace(F.translate(h, "abcdef", "123456"), "^0", "7")
    name = pick(1, "token", "secret", "api_key", "password", "auth_token", "client_secret", "ACCESS_TOKEN", "secret_key", "credential")
    sign = pick(2, "=", ":", ":=", "=>")
    quote = pick(3, '"', "'", '"')
    key = F.concat(name, F.lit(" "), sign)
    #: kind -> (token, text before, character beside it, label)
    kinds = [
        (F.substring(h, 1, 40), key, quote, 1), (F.substring(h, 1, 32), key, quote, 1), (h, key, quote, 1), (F.substring(b, 1, 40), key, quote, 1), (F.substring(b, 1, 24), key, pick(4, "", '"'), 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(b, 1, 16))), pick(5, "aws_access_key_id =", "key", "use"), pick(6, "", '"'), 1),
        (F.concat(pick(7, "ghp_", "gho_", "xoxb-", "sk_live_", "glpat-"), F.substring(b, 1, 36)), pick(8, "token:", "with", "export GH =", "curl -H"), pick(9, "", '"', "'"), 1),
        (F.substring(b, 1, 36), pick(10, "Authorization: Bearer", "Bearer", "auth:"), F.lit(""), 1), (F.concat(word(1), F.substring(h, 1, 3), F.lit("X"), F.substring(b, 1, 4)), F.concat(pick(11, "password", "passwd", "pwd"), F.lit(" ="), F.lit("")), quote, 1),
        (F.substring(h, 1, 40), F.concat(name, sign, quote), F.lit(""), 1),
        (F.substring(h, 1, 40), pick(12, "commit", "sha1:", "revision", "parent", "tree =", "sha ="), pick(13, "", '"'), 0), (F.substring(h, 1, 32), pick(14, "md5:", "checksum =", "etag:", "hash =", "digest"), pick(15, "", '"'), 0),
        (h, pick(16, "sha256:", "integrity =", "checksum:", "blob"), F.lit(""), 0), (F.substring(h, 1, 40), pick(17, "and the", "of", "see", "in version"), F.lit(""), 0), (F.substring(h, 1, 32), pick(18, "uuid", "id =", "build id:"), pick(19, "", '"'), 0),
        (F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), pick(20, "id:", "uuid =", "token of", "guid", "the"), pick(21, "", '"'), 0),
        (F.substring(digits, 1, 16), pick(22, "card", "order", "call", "the", "tel:", "number ="), F.lit(""), 0), (F.concat_ws("_", word(2), word(3), F.substring(digits, 1, 4)), pick(23, "the", "file =", "see", "name =", "src =", "token ="), pick(24, "", '"'), 0),
        (F.concat_ws("-", word(4), word(5), word(6), F.substring(digits, 1, 2)), pick(25, "to", "/", "href =", "password ="), pick(26, "", '"'), 0), (F.concat(F.lit("your_"), word(7), F.lit("_here_"), F.substring(digits, 1, 3)), key, quote, 0),
        (F.concat(F.repeat(pick(27, "x", "X", "0", "a", "1"), 20), F.substring(digits, 1, 1)), key, quote, 0), (F.concat(word(8), word(9), word(10), F.substring(digits, 1, 2)), pick(28, "of", "the", "and", "a"), F.lit(""), 0),
        (F.concat(word(11), F.initcap(word(12)), F.initcap(word(13)), F.initcap(word(14))), key, quote, 1), (F.concat_ws(" ", word(15), word(16), word(17), word(18)), key, quote, 1),
        (F.concat(pick(30, "P@ss", "S3cr3t!", "h#T$", "qW!9-", ""), F.substring(b, 1, 5), pick(31, "!", "#2024$x", "$x", "%&", "?Pa55")), key, pick(32, "", '"', "'"), 1),
        (F.concat(F.lit("eyJ"), F.substring(b, 1, 20), F.lit(".eyJ"), F.substring(b, 21, 30), F.lit("."), F.substring(b, 51, 30)), pick(33, "Bearer", "token:", "jwt =", "auth_token ="), pick(34, "", '"'), 1),
        (F.substring(F.regexp_replace(b, "[0-9]", ""), 1, 24), key, quote, 1),
        (F.concat_ws(".", word(19), word(20), word(21)), key, F.lit(""), 0), (F.concat(pick(35, "${", "<", "{{", "get(", "$"), word(22), F.lit("_"), word(23), pick(36, "}", ">", "}}", ")", "")), key, pick(37, "", '"'), 0),
        (word(24), key, pick(38, "", "", '"'), 0), (pick(39, "true", "null", "None", "Bearer", "Basic", "1", "3600", "the", "it", "{"), key, F.lit(""), 0),
        (F.concat(pick(40, "www.", "docs.", "img-1."), word(25), word(26), F.substring(digits, 1, 2), pick(41, ".com", ".org/index.html", ".tar.gz")), pick(42, "see", "at", "file:", "src =", "the"), pick(43, "", '"'), 0),
    ]
    at = F.pmod("id", F.lit(len(kinds)))
    build = lambda i: reduce(lambda c, k: c.when(at == k, kinds[k][i]), range(1, len(kinds)), F.when(at == 0, kinds[0][i]))
    made = spark.range(0, rows, 1, 1).select(
        "id", build(0).alias("token"), build(1).alias("before"), build(2).alias("beside"), F.lit("").alias("after"),
        pick(29, "src0", "src7", "src/app.py", "config/settings.yml", ".env", "tests/test_app.py", "docs/example.md", "lib/main.js").alias("path"), reduce(lambda c, k: c.when(at == k, F.lit(kinds[k][3])), range(1, len(kinds)), F.when(at == 0, F.lit(kinds[0][3]))).alias("label"))
    return made.select("id", "token", "before", F.concat("beside", "token", "beside").alias("within"), "after", "path", "label")


def train(labelled: DataFrame) -> RandomForestClassificationModel:
    """A forest on a labelled table in the form of :func:`labelled_findings`."""
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(labelled).withColumn("label", F.col("label").cast("double")))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", minInstancesPerNode=2).fit(data.select("features", "label"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(id, word_at, token, before, within, after, path) of every value given to a telling name and every run of key characters that may be a secret.

    A value follows a telling name and = or : on its line, in quotes (then with its spaces) or up to the next space; it may have
    any characters and any length. A run is of letters, digits and + / = _ - . with a digit in it, of 16 characters or more, or of 8
    or more where a telling name is in its word or the two words before. Words are cut at white space; word_at counts them from 0.
    """
    runs = rf"[A-Za-z0-9][A-Za-z0-9+/_.\-]{{6,}}[A-Za-z0-9]=?=?"
    text = F.coalesce(F.col(text_col), F.lit(""))
    # each value between two marks, which the text itself has none of, so that a word tells the values in it
    marked = F.regexp_replace(F.translate(text, OPEN + CLOSE, "\x03\x03"), f"({NAME})({VALUE})", f"$1{OPEN}$2{CLOSE}")
    rows = docs.select(
        F.col(id_col).alias("id"), (F.col(path_col) if path_col else F.lit(None).cast("string")).alias("path"), F.split(text, r"\s+").alias("words"),
        F.split(marked, r"\s+").alias("marked"), F.regexp_extract_all(text, F.lit(ASSIGNED), F.lit(0)).alias("given"))
    at_word = lambda i: F.get("words", i)

    def bare(rest: Column) -> Column:
        quoted = (F.length(rest) >= 2) & rest.rlike("^([\"'`])[\\s\\S]*\\1$")
        return F.when(quoted, F.substring(rest, F.lit(2), F.length(rest) - 2)).otherwise(F.regexp_replace(rest, "^[\"'`]+|[\"'`,;]+$", ""))

    # the words at which values begin, in the values' order; from here on one row a value, so nothing is looked at once for each other value
    begins = F.flatten(F.transform("marked", lambda w, i: F.array_repeat(i, F.size(F.split(w, OPEN)) - 1)))
    each = rows.filter(F.size("given") > 0).select("id", "path", "words", F.explode(F.arrays_zip("given", begins.alias("p"))).alias("z")).select("id", "path", "words", F.col("z.given").alias("given"), F.col("z.p").alias("p"))
    name = F.regexp_extract("given", "^" + NAME, 0)
    each = each.withColumn("name", name).withColumn("rest", F.substring("given", F.length("name") + 1, F.length("given")))
    last = F.col("p") + F.size(F.split("rest", r"\s+")) - 1
    values = each.select(
        "id", F.col("p").cast("long").alias("word_at"), bare(F.col("rest")).alias("token"), F.concat_ws(" ", *[at_word(F.col("p") - k) for k in (3, 2, 1)]).alias("before"),
        F.concat(F.regexp_extract("name", r"\S*$", 0), "rest").alias("within"), F.concat_ws(" ", at_word(last + 1), at_word(last + 2)).alias("after"), "path").filter("token <> ''")
    at = rows.select("id", "path", "words", "marked", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("p"))
    word = at_word(F.col("p"))
    some = at.filter((F.length(word) >= 8) & word.rlike("[0-9]"))
    found = some.select(
        "id", "path", "p", F.get("marked", F.col("p")).alias("mark"), F.concat_ws(" ", *[at_word(F.col("p") - k) for k in (3, 2, 1)]).alias("before"), word.alias("within"),
        F.concat_ws(" ", at_word(F.col("p") + 1), at_word(F.col("p") + 2)).alias("after"))
    found = found.withColumn("token", F.explode(F.array_distinct(F.regexp_extract_all("within", F.lit(runs), F.lit(0)))))
    told = F.lower(F.concat_ws(" ", "before", "within")).rlike(TELLING)
    # a value that goes on beyond this word holds a space, and no run does
    known = F.exists(F.regexp_extract_all("mark", F.lit(f"{OPEN}([^{CLOSE}]*){CLOSE}"), F.lit(1)), lambda v: bare(v) == F.col("token"))
    found = found.filter(F.col("token").rlike("[0-9]") & ((F.length("token") >= LEAST) | told) & ~known)
    return found.select("id", F.col("p").cast("long").alias("word_at"), "token", "before", "within", "after", "path").unionByName(values)


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """Every candidate with the forest's score: id, word_at, path, token_sha256, hint, length, score, is_secret.

    ``hint`` is the token's first four characters, so the result doesn't spread secrets. Null and empty texts
    have no candidates; repeated rows repeat theirs; a null path is no path.
    """
    rated = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(candidates(docs, id_col, text_col, path_col))))
    score = F.round(F.get(vector_to_array("probability"), F.lit(1)), 6)
    return rated.select(
        F.col("id").alias(id_col), "word_at", "path", F.sha2("token", 256).alias("token_sha256"), F.substring("token", 1, 4).alias("hint"), F.col("length").cast("long"),
        score.alias("score"), (score >= THRESHOLD).alias("is_secret"))
