"""Search: postings and BM25, nearest vectors, near-equal names, descriptor overlap, phrases of a lexicon."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.text import query_tokens, tokens
from kgspark.functions.vector import dot, unit
from kgspark.sources.shared import checkpointed

K1, B = 1.2, 0.75
#: Queries of a block, rows of a part at least, numbers in a part's vectors and scores held at once at most, and more than products of unit vectors err.
BLOCK, LEAST, MOST, SLACK = 4096, 4096, 1 << 22, 1e-9


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length): a row for each term of each document; built once, reused by searches."""
    rows = docs.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    rows = rows.select(key, F.size("_t").cast("long").alias("length"), F.explode("_t").alias("term"))
    return rows.groupBy(key, "length", "term").agg(F.count("*").alias("tf")).select(key, "term", "tf", "length")


def bm25(index: DataFrame, queries: DataFrame, key: str, n_docs: int, mean_length: float) -> DataFrame:
    """(query_id, key, score) of documents with any of a query's terms.  queries: query_id, query.

    Only postings of asked terms take part.  Inverse document frequency has a
    floor just above zero, so very common terms still rank.
    """
    asked = queries.select("query_id", F.explode(query_tokens(F.col("query"))).alias("term"))
    return _bm25(index, asked, key, n_docs, mean_length)


def _bm25(index: DataFrame, asked: DataFrame, key: str, n_docs: int, mean_length: float) -> DataFrame:
    """As ``bm25``, of words asked (query_id, term); an index may say in ``n`` for how many documents a row stands."""
    hit = index.join(asked.select("term").distinct(), "term", "left_semi")
    df = hit.groupBy("term").agg((F.sum("n") if "n" in index.columns else F.count("*")).alias("df"))
    idf = F.greatest(F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean_length))
    scored = hit.join(df, "term").select("term", key, weight.alias("w")).join(asked, "term")
    return scored.groupBy("query_id", key).agg(F.sum("w").alias("score"))


def search(docs: DataFrame, queries: DataFrame, key: str, text: str, limit: int = 10) -> DataFrame:
    """(query_id, rank, key, score): the best documents of each query, ties by key."""
    index = postings(docs, key, text)
    stats = docs.agg(F.count("*"), F.avg(F.size(tokens(F.coalesce(F.col(text), F.lit("")))))).first()
    found = bm25(index, queries, key, stats[0], stats[1] or 1.0)
    return top(found.withColumn("score", F.round("score", 9)), ["query_id"], "score", key, limit)


def top(scored: DataFrame, by: list[str], score: str, key: str, k: int) -> DataFrame:
    """The k best of each group with their rank; a window whose rank limit Spark applies before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), key)
    out = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select(*by, F.col("rank").cast("long").alias("rank"), key, score)


def against(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", kind: str | None = None, block: int = 2000) -> DataFrame:
    """(query_id, key, cosine) of every query and every other row (of the same kind): a stated query set against all rows.

    Queries are held in blocks of about ``block``; each row is sent once for each
    block, so the work is queries times rows and nothing is gathered whole.
    """
    blocks = max(1, -(-queries.count() // block))
    own = [F.col(kind).alias("kind")] if kind else [F.lit(0).alias("kind")]
    qs = queries.select("query_id", unit(F.col(vector)).alias("q"), *own).withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    qs = qs.groupBy("_b").agg(F.collect_list(F.struct("query_id", "q", "kind")).alias("qs"))
    rows = vectors.select(F.col(key), unit(F.col(vector)).alias("v"), *own).where("v IS NOT NULL")
    tiled = rows.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(qs, "_b")
    pairs = tiled.select(key, "v", "kind", F.explode("qs").alias("x")).where((F.col("x.kind") == F.col("kind")) & (F.col("x.query_id") != F.col(key)))
    return pairs.select("x.query_id", key, dot(F.col("x.q"), F.col("v")).alias("cosine"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, cosine): the k nearest of all rows, exactly, ties by key.

    Every block of queries meets every part of the rows, as matrices.  The
    product nominates; what is near its k-th best is summed again in the order of
    components, as ``dot`` does, so that equal vectors score alike wherever they
    stand.  Vectors of different lengths are not compared.
    """
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("width")).first()
    rows = max(1, min(max(LEAST, -(-size["n"] // 16)), MOST // max(1, size["width"] or 1)))
    parts, blocks = max(1, -(-size["n"] // rows)), max(1, -(-queries.count() // BLOCK))
    kind = vectors.schema[key].dataType
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.where("query_id IS NOT NULL").select("query_id", F.col("query_id").cast(kind).alias("own"), unit(F.col(vector)).alias("q"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
    right = vectors.select(F.col(key).alias("key"), unit(F.col(vector)).alias("v"), F.pmod(F.xxhash64(key), F.lit(parts)).alias("to_part")).where("key IS NOT NULL AND v IS NOT NULL")
    left, right = left.select("*", numbers(parts).alias("part")), right.select("*", numbers(blocks).alias("to_block"))
    right = right.toDF(*right.columns)  # columns of its own

    def local(asked: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        at, to, score = _nearest(asked, rows, k)
        cosine = pa.array(score, pa.float64(), mask=pc.is_null(asked["q"].take(pa.array(at))).to_numpy())
        return pa.table({"query_id": asked["query_id"].take(pa.array(at)), key: rows["key"].take(pa.array(to)), "cosine": cosine})

    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, `{key}` {kind.simpleString()}, cosine double"
    found = left.groupBy("block", "part").cogroup(right.groupBy("to_block", "to_part")).applyInArrow(local, schema)
    return top(found, ["query_id"], "cosine", key, k)


def _nearest(asked: pa.Table, rows: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``asked``, place in ``rows``, cosine) of the k nearest of each; rows in the order of their keys."""
    width = lambda c: pc.fill_null(pc.list_value_length(c), -1).to_numpy()
    matrix = lambda c, at, n: c.take(pa.array(at)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    own, keys, wide, widths = asked["own"].to_numpy(), rows["key"].to_numpy(), width(asked["q"]), width(rows["v"])
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i in np.flatnonzero(wide < 0):  # without a vector it is as far from all rows
        to = np.flatnonzero(keys[: k + np.count_nonzero(keys == own[i])] != own[i])[:k]
        out.append((np.full(len(to), i), to, np.zeros(len(to))))
    for n in set(wide[wide > 0]) & set(widths):
        to, at_all = np.flatnonzero(widths == n), np.flatnonzero(wide == n)
        x = np.ascontiguousarray(matrix(rows["v"], to, n).T)
        step = max(1, MOST // len(to))
        for lo in range(0, len(at_all), step):
            at = at_all[lo : lo + step]
            a = matrix(asked["q"], at, n)
            near = a @ x
            near[np.isnan(near)] = np.inf  # comes first, as Spark orders it
            for i, (first, last) in enumerate(zip(np.searchsorted(keys[to], own[at], "left"), np.searchsorted(keys[to], own[at], "right"))):
                near[i, first:last] = -np.inf  # the query itself
            floor = np.partition(near, len(to) - k, axis=1)[:, len(to) - k] - SLACK if len(to) > k else np.full(len(at), -np.inf)
            r, c = np.nonzero((near >= floor[:, None]) & (near > -np.inf))
            score = np.zeros(len(r))
            for d in range(n):
                score += a[r, d] * x[d, c]
            order = np.lexsort((c, -np.where(np.isnan(score), np.inf, score), r))
            r, c, score = r[order], c[order], score[order]
            kept = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append((at[r[kept]], to[c[kept]], score[kept]))
    return tuple(np.concatenate(x) for x in zip(*out))


def similar(vectors: DataFrame, queries: DataFrame, floor: float, kind: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, cosine): rows of a query's kind with at least that cosine, as suspected duplicates of proposed entities."""
    return against(vectors, queries, key, vector, kind).where(F.col("cosine") >= floor)


def best_per_document(chunks: DataFrame, by: list[str], doc: str, score: str, chunk: str) -> DataFrame:
    """The best-scored chunk of each document, ties by chunk."""
    w = Window.partitionBy(*by, doc).orderBy(F.desc(score), chunk)
    return chunks.withColumn("_no", F.row_number().over(w)).where("_no = 1").drop("_no")


def suggest(scored: DataFrame, by: str = "query_id", score: str = "cosine", floor: float = 0.60, lead: float = 0.05) -> DataFrame:
    """The best candidate of each query, where it is over the floor and leads the second by ``lead``; ties by the other columns.

    The two best of each query are enough, as ``nearest`` gives them.
    """
    w = Window.partitionBy(by).orderBy(F.desc(score), *(c for c in scored.columns if c not in (by, score)))
    rows = scored.withColumn("_no", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w)).where("_no = 1")
    clear = F.col(score) - F.coalesce("_next", F.lit(-1.0)) >= lead
    return rows.where((F.col(score) >= floor) & clear).drop("_no", "_next")


def overlap(sets: DataFrame, floor: float = 0.75, key: str = "id", items: str = "words") -> DataFrame:
    """(a, b, jaccard): pairs of sets that share at least that part of their union, a < b.

    By prefix filter: two such sets share one of their rarest items, so each set
    is filed under its (1 - floor) rarest and only sets under one item are compared.
    """
    rows = sets.select(F.col(key).alias("id"), F.array_distinct(items).alias("s")).where(F.size("s") > 0)
    each = rows.select("id", F.explode("s").alias("x"))
    freq = each.groupBy("x").agg(F.count("*").alias("f"))
    ranked = each.join(freq, "x").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "x"))).alias("r"))
    n = F.size("r")
    prefix = F.slice("r", 1, (n - F.ceil(n * floor) + 1).cast("int"))
    filed = ranked.select("id", F.transform("r", lambda x: x["x"]).alias("s"), F.explode(prefix).alias("p")).select("id", "s", "p.x")
    a, b = filed.alias("a"), filed.alias("b")
    n_a, n_b = F.size("a.s"), F.size("b.s")
    close = (n_a >= n_b * floor) & (n_b >= n_a * floor)
    pairs = a.join(b, (F.col("a.x") == F.col("b.x")) & (F.col("a.id") < F.col("b.id")) & close)
    both = F.size(F.array_intersect("a.s", "b.s"))
    pairs = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), (both / (n_a + n_b - both)).alias("jaccard"))
    return pairs.where(F.col("jaccard") >= floor).distinct()


def lengths(phrases: DataFrame, phrase: str) -> list[int]:
    """The numbers of words that phrases have."""
    return sorted(r[0] for r in phrases.select(F.size(tokens(F.col(phrase)))).distinct().collect() if r[0] and r[0] > 0)


def lexicon_match(texts: DataFrame, lexicon: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, target, phrase): lexicon phrases that a text has as whole words.

    Runs of as many words as phrases have are looked up by an equi-join, so no
    phrase is compared with every text.
    """
    w = tokens(F.col(text))
    sizes = lengths(lexicon, "phrase")
    if not sizes:
        return texts.join(lexicon.select("phrase", "target"), F.lit(False)).select(key, "target", "phrase")
    rows = texts.select(key, w.alias("w"))

    def grams(n: int):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))

    rows = rows.select(key, F.explode(F.array_distinct(F.concat(*map(grams, sizes)))).alias("phrase"))
    return rows.join(lexicon.select("phrase", "target").distinct(), "phrase").select(key, "target", "phrase").distinct()


def lexicon_search(lexicon: DataFrame, term: str) -> DataFrame:
    """(phrase, target, score): 3 for the phrase itself, 2 for a beginning, 1 for a part."""
    t = F.lit(term.lower())
    p = F.lower("phrase")
    score = F.when(p == t, 3).when(F.startswith(p, t), 2).when(F.contains(p, t), 1)
    return lexicon.select("phrase", "target", score.cast("long").alias("score")).where("score IS NOT NULL")


def _said(nodes: DataFrame):
    """What a node is searched by; aliases and tags are arrays, where the table has them."""
    return F.concat_ws(" ", *(c for c in ("label", "aliases", "tags", "summary") if c in nodes.columns))


def entity_search(nodes: DataFrame, terms: DataFrame, limit: int = 6) -> DataFrame:
    """(term, rank, id): nodes by words of their labels, aliases, tags and summaries; current ones first, then by BM25, then by id.

    Nodes of the same words score alike, so each such class is scored once for
    each distinct set of asked words: of its nodes, current or not, only the
    first ``limit`` by id can be among the best.
    """
    now = F.coalesce("status", F.lit("current")) == "current"
    rows = nodes.select("id", F.array_sort(tokens(_said(nodes))).alias("words"), now.alias("now"))
    w = Window.partitionBy("words", "now").orderBy("id")
    classes = rows.groupBy("words").agg(F.count("*").alias("n"))
    classes = checkpointed(classes.select(F.monotonically_increasing_id().alias("class"), "words", "n"))
    first = rows.select("*", F.row_number().over(w).alias("no")).where(F.col("no") <= limit).join(classes.select("words", "class"), "words").select("class", "now", "id")
    stats = classes.agg(F.sum("n"), F.sum(F.col("n") * F.size("words")) / F.sum("n")).first()
    index = classes.select("class", "n", F.size("words").cast("long").alias("length"), F.explode("words").alias("term")).groupBy("class", "n", "length", "term").agg(F.count("*").alias("tf"))

    asked = terms.select("term", F.array_sort(query_tokens(F.col("term"))).alias("asked")).where(F.size("asked") > 0).distinct()
    sets = asked.select(F.col("asked").alias("query_id")).distinct()
    each = sets.select("query_id", F.explode("query_id").alias("term"))
    scored = _bm25(index, each, "class", stats[0] or 0, stats[1] or 1.0).withColumn("score", F.round("score", 9))
    # Current nodes come first, so the best classes of those and of the others are looked for apart; ties are all kept.
    kinds = first.select("class", "now").distinct()
    best = scored.join(kinds, "class").withColumn("no", F.rank().over(Window.partitionBy("query_id", "now").orderBy(F.desc("score")))).where(F.col("no") <= limit)
    found = best.select("query_id", "class", "now", "score").join(first, ["class", "now"])
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("now"), F.desc("score"), "id"))).where(F.col("rank") <= limit)
    found = found.select("query_id", F.col("rank").cast("long").alias("rank"), "id")
    return asked.join(found, asked["asked"] == found["query_id"]).select("term", "rank", "id")


def any_entity(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """(term): those for which ``entity_search`` finds anything, by a join on distinct words alone."""
    words = nodes.select(F.explode(tokens(_said(nodes))).alias("word")).distinct()
    asked = terms.select("term", F.explode(query_tokens(F.col("term"))).alias("word"))
    return asked.join(words, "word", "left_semi").select("term").distinct()


def dense_documents(scored: DataFrame, doc: str, chunk: str, n_chunks: int = 200, n_docs: int = 20, by: str = "query_id", score: str = "cosine") -> DataFrame:
    """(query, rank, doc, score): of each query's best chunks, each document's best one, and of these the best documents.

    ``n_chunks`` chunks of each query are enough, as ``nearest`` gives them.
    """
    w = Window.partitionBy(by).orderBy(F.desc(score), chunk)
    best = scored.select(by, doc, chunk, score, F.row_number().over(w).alias("_no")).where(F.col("_no") <= n_chunks)
    return top(best.groupBy(by, doc).agg(F.max(score).alias(score)), [by], score, doc, n_docs)


def descriptor_ranks(descriptors: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, id, score, rank) of ``descriptor_rank`` for every question (query_id, query), by an equi-join on words."""
    asked = questions.select("query_id", F.explode(query_tokens(F.col("query"))).alias("word"))
    worth = lambda c, n: descriptors.select("id", F.explode(F.array_distinct(c)).alias("word"), F.lit(n).alias("n"))
    found = worth("words", 1).union(worth("class_words", 2)).join(asked, "word").groupBy("query_id", "id").agg(F.sum("n").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"))
    return found.withColumn("rank", F.rank().over(w).cast("long"))


def descriptor_rank(descriptors: DataFrame, question: str) -> DataFrame:
    """(id, score, rank): descriptors by words shared with a question, class words twice; ties share a rank.

    descriptors: id, words, class_words (arrays of words).
    """
    q = query_tokens(F.lit(question))
    score = F.size(F.array_intersect("words", q)) + 2 * F.size(F.array_intersect("class_words", q))
    rows = descriptors.select("id", score.cast("long").alias("score")).where("score > 0")
    best = rows.groupBy("score").count()
    # Ranks from the counts of distinct scores, of which there are as many as a question's words allow.
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = best.select(F.col("score").alias("_s"), (F.coalesce(F.sum("count").over(w), F.lit(0)) + 1).cast("long").alias("rank"))
    return rows.join(ranks, rows["score"] == ranks["_s"]).select("id", "score", "rank")
