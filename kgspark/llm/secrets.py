"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a run of at least 16 letters, digits and ``+/_-``, or whatever is
assigned to a name like password, secret or token: at least 6 characters other
than white space, quotes, commas and semicolons.  The forest looks at its length,
its character transitions (mean log probability under transitions counted in the
dictionary, switches of character class, share of digits), how much of it
dictionary words cover, the path it was found under and the words around it.  It
is trained on labelled findings: a table of candidate, path, before, after,
label, by default the generated ``labelled_findings``, of a stated number of
rows; at most ``most`` rows are taken, in the order of a hash of what they say,
so the forest does not depend on partitions.  The dictionary is the words that
the whole corpus has often.  Everything is DataFrame and SQL functions.

Features take time in proportion to a candidate's length, so a document may hold
an encoded image of many megabytes.

Defined results: null and empty texts have no findings; a null path is an empty
path; repeated rows and repeated candidates give a finding each; equal findings
have equal scores; a score of 0.5 is a secret; columns of other names are ignored
by ``scan`` and stay as they are in ``redacted``.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.shared import unused, written

RUN = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
#: What is assigned to a name that says so, in texts that have such a name.
NAMED = r"(?i:passw(?:or)?d|passwd|pwd|secret|token|api_?key|credential)[\"']?\s?[=:]\s?[\"'`]?"
ASSIGNED = r"(?<=(?i:passw(?:or)?d|passwd|pwd|secret|token|api_?key|credential)[\"']?\s?[=:]\s?[\"'`]?)(?![\s\"'`])[^\s\"'`,;]{6,}"
#: Characters of a text around a candidate in which neighbouring words are looked for.
AROUND = 160
#: Times that a word of the corpus occurs to be in the dictionary, and its letters.
MIN_COUNT, MIN_LETTERS, MAX_LETTERS = 5, 4, 20
#: Rows of the generated labelled findings.
N_LABELLED = 6000
#: Labelled findings that the forest is trained on, at most.
MOST_LABELLED = 200_000
MARK = "[SECRET]"
#: Characters that transitions tell apart: letters in any case, any digit as 0, the rest as -.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0-"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
FEATURES = [
    "length", "transition", "switches", "digits", "coverage",
    "path_test", "path_config", "near_secret", "near_digest", "near_sample", "assigned", "quoted",
]
#: Neighbouring words and path parts that the forest is told of.
SECRET_WORDS = r"token|secret|key|passw|pwd|auth|credential|bearer|private"
DIGEST_WORDS = r"commit|sha1|sha256|md5|hash|checksum|digest|uuid|revision|etag|trace|request|build|version|fingerprint"
SAMPLE_WORDS = r"example|sample|placeholder|dummy|fake|your|changeme|test"
PATH_TEST = r"test|example|sample|fixture|mock|doc|readme"
PATH_CONFIG = r"\.env|config|settings|credential|secret|deploy|\.ya?ml|\.ini|\.tf"


def _pattern(text: Column) -> Column:
    """The pattern of candidates for this text: the longer one only where a name that says so occurs."""
    return F.when(text.rlike(NAMED), F.lit(f"{ASSIGNED}|{RUN}")).otherwise(F.lit(RUN))


def _cut(text: Column) -> tuple[Column, Column]:
    """The candidates of a text, and what is between them (one more)."""
    return F.regexp_extract_all(text, _pattern(text), 0), F.split(text, _pattern(text), -1)


def findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(doc_id, text_hash, nth, candidate, path, before, after): the nth candidate of a text, from 0, and what is around it.

    before has the rest of its own word and two words before, after the rest of its word and one after.
    """
    c = F.col(text)
    found, between = _cut(c)
    held = docs.where(c.rlike(RUN) | c.rlike(NAMED)).select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(c).alias("text_hash"),
        F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"),
        found.alias("found"),
        F.transform(between, lambda x: F.struct(F.right(x, F.lit(AROUND)).alias("end"), F.left(x, F.lit(AROUND)).alias("start"))).alias("between"),
    )

    def before(k: Column) -> Column:
        # A short stretch does not end the words before it: what two candidates before left goes first.
        parts = [F.coalesce(F.get("between", k - i)["end"], F.lit("")) for i in (2, 1, 0)]
        names = [F.right(F.coalesce(F.get("found", k - i), F.lit("")), F.lit(AROUND)) for i in (2, 1)]
        return F.regexp_extract(F.concat(parts[0], names[0], parts[1], names[1], parts[2]), r"(?:[^\x20\x09-\x0D]*[\x20\x09-\x0D]+){0,2}[^\x20\x09-\x0D]*$", 0)

    after = lambda k: F.regexp_extract(F.get("between", k + 1)["start"], r"^[^\x20\x09-\x0D]*(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]*)?", 0)
    each = F.transform("found", lambda x, k: F.struct(k.cast("long").alias("nth"), x.alias("candidate"), before(k).alias("before"), after(k).alias("after")))
    rows = held.select("doc_id", "text_hash", "path", F.explode(each).alias("x"))
    return rows.select("doc_id", "text_hash", "x.nth", "x.candidate", "path", "x.before", "x.after")


def dictionary(docs: DataFrame, text: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): runs of ASCII letters, in lower case, that the corpus has at least ``min_count`` times."""
    words = docs.select(F.explode(F.split(F.lower(text), "[^a-z]+")).alias("word"))
    words = words.where(F.length("word").between(MIN_LETTERS, MAX_LETTERS))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def transitions(words: DataFrame) -> list[float]:
    """Log probabilities of one character of ALPHABET after another, row by row, with one added to each count."""
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2)))).alias("p"))
    counts = {row["p"]: row["count"] for row in pairs.groupBy("p").count().collect()}  # at most 26 squared
    table = [[1 + counts.get(a + b, 0) for b in ALPHABET] for a in ALPHABET]
    return [math.log(n / sum(row)) for row in table for n in row]


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]", "0"), "[^a-z0]", "-")


def features(found: DataFrame, words: DataFrame, table: list[float]) -> DataFrame:
    """Adds the columns FEATURES."""
    c = F.col("candidate")
    n = F.length(c)
    logs = F.array(*(F.lit(x) for x in table))
    found = found.withColumn("plain", _plain(c)).withColumn("_log", logs)
    # Characters once as an array, and each with its next: linear in the candidate's length.
    place = lambda x: f"locate({x}, '{ALPHABET}') - 1"
    pairs = f"zip_with(split(plain, ''), slice(split(plain, ''), 2, length(plain)), (a, b) -> _log[({place('a')}) * {len(ALPHABET)} + {place('b')}])"
    transition = F.expr(f"aggregate(slice({pairs}, 1, length(plain) - 1), 0D, (t, x) -> t + x)") / (n - 1)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]", "-"), "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    switches = (F.length(F.regexp_replace(classes, r"(.)\1*", "$1")) - 1) / (n - 1)
    has = lambda where, what: F.when(F.lower(where).rlike(what), 1.0).otherwise(0.0)
    found = found.withColumns(
        {
            "length": F.log2(n).cast("double"),
            "transition": transition,
            "switches": switches,
            "digits": F.length(F.regexp_replace(c, "[^0-9]", "")) / n,
            "path_test": has(F.col("path"), PATH_TEST),
            "path_config": has(F.col("path"), PATH_CONFIG),
            "near_secret": has(F.col("before"), SECRET_WORDS),
            "near_digest": has(F.col("before"), DIGEST_WORDS),
            "near_sample": has(F.concat_ws(" ", "before", "candidate"), SAMPLE_WORDS),
            "assigned": F.when(F.col("before").rlike(r"[=:]\s*[\"'`]*$"), 1.0).otherwise(0.0),
            "quoted": F.when(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]"), 1.0).otherwise(0.0),
        }
    ).drop("plain", "_log")
    parts = F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z]+"), lambda x: F.length(x) >= MIN_LETTERS))
    # Copies of a candidate share their words: look up distinct ones.
    pieces = found.select("candidate").distinct().select("candidate", F.explode(parts).alias("word"))
    covered = pieces.join(words.select("word"), "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("covered"))
    found = found.join(covered, "candidate", "left")
    return found.withColumn("coverage", F.coalesce("covered", F.lit(0)) / n).drop("covered")


#: What generated labelled findings say before the candidate, and under which path.
TRUE_BEFORE = ["token = \"", "api_key: ", "secret=", "password = '", "auth_token: \"", "aws_secret_access_key = ", "bearer ", "private_key=\"", "client_secret: "]
FALSE_BEFORE = ["commit ", "sha256: ", "md5 = \"", "checksum=", "request ", "build ", "see ", "the ", "revision: ", "uuid = "]
PLAIN_BEFORE = ["the ", "of and ", "a ", "to the ", "in ", "| ", "", "de la ", "und die "]
SAMPLE_BEFORE = ["example token = \"", "your key: ", "sample secret=", "test password = '"]
TRUE_PATHS = ["src1", "app/.env", "deploy/config.yaml", "src7", "settings.ini", "web"]
FALSE_PATHS = ["tests/fixtures/a", "docs/readme", "src2", "examples/x", "src9", "web"]
SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "sch", "ung", "cion", "ment", "que", "eau"]


def labelled_findings(spark: SparkSession, n: int = N_LABELLED) -> DataFrame:
    """(candidate, path, before, after, label): n generated findings, half of them secrets."""
    base62 = "0123456789" + _UPPER + _LOWER
    pick = lambda xs, salt: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(xs))) + 1).cast("int"))
    draw = lambda alphabet, size, salt: F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.substr(F.lit(alphabet), (F.pmod(F.xxhash64("id", i, F.lit(salt)), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))))
    speech = lambda count, salt, gap="": F.concat_ws(gap, F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.element_at(F.array(*(F.lit(x) for x in SYLLABLES)), (F.pmod(F.xxhash64("id", i, F.lit(salt)), F.lit(len(SYLLABLES))) + 1).cast("int"))))
    hexes = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)).cast("binary"), 256)
    cases = [
        # candidate, before, path, label
        (F.left(hexes("a"), F.lit(40)), TRUE_BEFORE, TRUE_PATHS, 1),
        (F.upper(F.left(hexes("b"), F.lit(40))), ["TOKEN = \"", "SECRET=", "API_KEY: "], TRUE_PATHS, 1),
        (draw(base62, 36, "c"), TRUE_BEFORE, TRUE_PATHS, 1),
        (draw(base62 + "+/", 44, "d"), TRUE_BEFORE, TRUE_PATHS, 1),
        (F.concat(F.lit("AKIA"), draw(_UPPER + "234567", 16, "e")), TRUE_BEFORE + PLAIN_BEFORE, TRUE_PATHS, 1),
        (F.concat(F.lit("ghp_"), draw(base62, 36, "f")), TRUE_BEFORE + PLAIN_BEFORE, TRUE_PATHS, 1),
        (F.left(hexes("g"), F.lit(32)), TRUE_BEFORE, TRUE_PATHS, 1),
        (F.concat(speech(2, "q"), draw("0123456789!@#$%&*", 4, "r"), draw(base62, 3, "s")), ["password = '", "pwd=", "Password: ", "db_password=\"", "secret: "], TRUE_PATHS, 1),
        (F.concat(draw(base62 + "!@#$%^&*.", 10, "t"), draw("0123456789!@#$", 2, "u")), ["password = '", "pwd=", "passwd: ", "token=\"", "credential = \""], TRUE_PATHS, 1),
        (F.concat(F.lit("sk-"), draw(base62, 20, "v")), TRUE_BEFORE + PLAIN_BEFORE, TRUE_PATHS, 1),
        (F.concat(F.lit("eyJ"), draw(base62, 30, "w"), F.lit("_"), draw(base62 + "_-", 30, "x")), TRUE_BEFORE + ["bearer "], TRUE_PATHS, 1),
        (speech(3, "y"), ["the password: ", "secret: ", "token = ", "a token: ", "das passwort pwd: "], FALSE_PATHS, 0),
        (F.concat(F.lit("<"), speech(2, "z"), F.lit("_"), speech(2, "aa"), F.lit(">")), ["password = '", "token: ", "secret="], FALSE_PATHS, 0),
        (F.concat(F.lit("${"), F.upper(speech(3, "bb", "_")), F.lit("}")), ["password = '", "token=", "secret: "], FALSE_PATHS + TRUE_PATHS, 0),
        (F.concat_ws("-", speech(2, "cc"), speech(3, "dd"), speech(2, "ee")), PLAIN_BEFORE, FALSE_PATHS + TRUE_PATHS, 0),
        (draw(base62, 20, "h"), TRUE_BEFORE, TRUE_PATHS, 1),
        (speech(9, "i"), PLAIN_BEFORE, FALSE_PATHS, 0),
        (F.upper(speech(9, "j")), PLAIN_BEFORE, FALSE_PATHS, 0),
        (speech(6, "k", "_"), PLAIN_BEFORE + TRUE_BEFORE, FALSE_PATHS, 0),
        (F.initcap(speech(8, "l")), PLAIN_BEFORE + TRUE_BEFORE, FALSE_PATHS, 0),
        (F.left(hexes("m"), F.lit(40)), FALSE_BEFORE, FALSE_PATHS, 0),
        (F.left(hexes("n"), F.lit(32)), FALSE_BEFORE + SAMPLE_BEFORE, FALSE_PATHS, 0),
        (draw("0123456789", 16, "o"), PLAIN_BEFORE, FALSE_PATHS, 0),
        (F.repeat(pick(["x", "-", "0", "_", "ab", "="], "p"), F.lit(20)), PLAIN_BEFORE + TRUE_BEFORE, FALSE_PATHS, 0),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(cases)))
    chosen = lambda values: F.coalesce(*(F.when(kind == i, v) for i, v in enumerate(values)))
    before = chosen([pick(c[1], "before") for c in cases])
    close = F.regexp_extract(before, "([\"'])$", 1)
    return spark.range(n).select(
        chosen([c[0] for c in cases]).alias("candidate"),
        chosen([pick(c[2], "path") for c in cases]).alias("path"),
        before.alias("before"),
        F.concat(close, F.lit(" "), speech(2, "after")).alias("after"),
        chosen([F.lit(float(c[3])) for c in cases]).alias("label"),
    )


def train(labelled: DataFrame, words: DataFrame, table: list[float], trees: int = 40, depth: int = 7, most: int = MOST_LABELLED) -> RandomForestClassificationModel:
    # Written: the forest and its summary read their rows several times, and the plan of the features is long.
    rows = written(features(labelled, words, table).select("candidate", "before", "after", "path", "label", *FEATURES), "labelled")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    # One partition in a fixed order: the forest's samples depend on both.
    rows = rows.orderBy(F.xxhash64("candidate", "before", "after", "path", "label"), "candidate", "label").limit(most).select("features", "label").coalesce(1)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featuresCol="features", labelCol="label")
    return forest.fit(rows)


def verdicts(found: DataFrame, model: RandomForestClassificationModel, words: DataFrame, table: list[float]) -> DataFrame:
    """Adds score, the forest's probability of a secret, and is_secret."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(found, words, table))
    rows = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return rows.withColumn("is_secret", F.col("score") >= 0.5).drop("features", "rawPrediction", "probability", "prediction")


def scan(docs: DataFrame, labelled: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(doc_id, text_hash, nth, candidate, path, before, after, *FEATURES, score, is_secret) of every candidate of every row."""
    words = written(dictionary(docs, text), "dictionary")
    table = transitions(words)
    model = train(labelled_findings(docs.sparkSession) if labelled is None else labelled, words, table)
    return verdicts(written(findings(docs, doc_id, text, path), "findings"), model, words, table)


def redacted(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with MARK in the place of every candidate that is a secret."""
    key, hash_, nths = unused(docs, "doc", "hash", "nths")
    secrets = found.where("is_secret").groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(hash_)).agg(F.collect_set("nth").alias(nths))
    out = docs.join(secrets, docs[doc_id].eqNullSafe(secrets[key]) & (F.xxhash64(docs[text]) == secrets[hash_]), "left")
    candidates, between = _cut(F.col(text))
    here = F.transform(between, lambda x, i: F.concat(x, F.when(F.array_contains(nths, i.cast("long")), F.lit(MARK)).otherwise(F.coalesce(F.get(candidates, i), F.lit("")))))
    clean = F.when(F.col(nths).isNull(), F.col(text)).otherwise(F.array_join(here, ""))
    return out.withColumn(text, clean).drop(key, hash_, nths)
