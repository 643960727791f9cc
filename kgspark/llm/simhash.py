"""SimHash near-dedup with multi-index hashing.

A fingerprint is cut into two halves.  If two fingerprints differ in at most
three bits, some half differs in at most one, so each fingerprint looks up the
33 values within one bit of its half in a table of all halves, and the full
distance decides.  Equal fingerprints are one entry of the table, and links are
turned into components with one row for each node, so groups of copies are never
expanded into pairs.  Joins are merges by hint: their sides grow with the input,
and several that Spark finds small enough to broadcast fill a driver together.

Defined results: null or word-less text has fingerprint zero, linked like any
other; repeated rows have equal fingerprints and share a component; a null
doc_id is never the name of a component unless all its rows have null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm.shared import connected_components, removed, written
from kgspark.llm.text import chunks, joined

SEED = 42
HALF = 32
LAST = (1 << 63) - 1  # stands for a null doc_id


def fingerprint(text: bytes, starts: np.ndarray, ends: np.ndarray, shingle: int) -> int:
    """Of words joined by single spaces, given where each word starts and ends."""
    import xxhash

    n = len(starts)
    if not n:
        return 0
    first, last = (starts[: n - shingle + 1], ends[shingle - 1 :]) if n > shingle else (starts[:1], ends[-1:])
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, np.int64), len(first)
    for lo in range(0, total, 1 << 16):
        h = np.array([digest(text[a:b], SEED) for a, b in zip(first[lo : lo + (1 << 16)].tolist(), last[lo : lo + (1 << 16)].tolist())], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", out: str = "fp") -> DataFrame:
    """Adds the fingerprint of each whole text, and a hash of its words, as (signed) longs; the text itself is left out."""
    keep = [c for c in docs.columns if c not in (text, out, "words_hash")]
    docs = docs.select(*keep, text)

    def run(batches):
        import xxhash

        for batch in batches:
            prints, hashes = [], []
            for lo, hi, words in chunks(batch.column(len(keep)), lower=True):
                for d in range(hi - lo):
                    body, starts, ends = joined(words, d)
                    prints.append(fingerprint(body, starts, ends, shingle))
                    hashes.append(xxhash.xxh64_intdigest(body))
            found = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (prints, hashes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], [*keep, out, "words_hash"])

    added = [T.StructField(out, T.LongType()), T.StructField("words_hash", T.LongType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[:-1], *added]))


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): the pairs of different values of ``fp`` that differ in ``distance`` bits at most, each once.

    The ball around a half has radius ``distance // 2``, 0 or 1.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves serve distances up to 3")
    prints = prints.select("fp").distinct()
    halves = F.explode(
        F.array(
            F.struct(F.lit(0).alias("part"), F.shiftrightunsigned("fp", HALF).cast("long").alias("half")),
            F.struct(F.lit(1).alias("part"), F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1)).alias("half")),
        )
    )
    table = prints.select(F.col("fp").alias("b"), halves.alias("h")).select("b", "h.part", "h.half")
    ball = [0, *(1 << i for i in range(HALF))] if distance >= 2 else [0]
    flips = F.explode(F.array(*(F.lit(x).cast("long") for x in ball)))
    probes = (
        table.withColumnRenamed("b", "a")
        .select("a", "part", "half", flips.alias("flip"))
        .select("a", "part", F.col("half").bitwiseXOR(F.col("flip")).alias("half"))
    )
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    found = probes.join(table.hint("merge"), (probes["part"] == table["part"]) & (probes["half"] == table["half"]) & near)
    return found.select("a", "b").distinct()


def components(prints: DataFrame, pairs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Adds component_id, the smallest doc_id that links reach, to rows with ``fp``."""
    smallest = prints.groupBy("fp").agg(F.min(doc_id).alias("doc"))
    group = connected_components(pairs)
    nodes = smallest.join(group.hint("merge"), smallest["fp"] == group["node"], "left").select(
        "fp", "doc", F.coalesce("component", "fp").alias("component")
    )
    named = nodes.groupBy("component").agg(F.min("doc").alias("component_id"))
    names = nodes.join(named.hint("merge"), "component").select(F.col("fp").alias("node_fp"), "component_id")
    return prints.join(names.hint("merge"), prints["fp"] == names["node_fp"], "left").drop("node_fp")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    prints = fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle).drop("words_hash")
    prints = written(prints, "fingerprints")
    return components(prints, links(prints, distance))


def shingle_sets(docs: DataFrame, shingle: int, text: str = "text") -> DataFrame:
    """Adds ``shingles``, the distinct hashes of the word shingles of each text (of the whole sequence where it is shorter)."""
    keep = [c for c in docs.columns if c not in (text, "shingles")]
    docs = docs.select(*keep, text)

    def run(batches):
        for batch in batches:
            for first, end, words in chunks(batch.column(len(keep)), lower=True):  # a chunk leaves before the next is read
                found, bounds = words.shingles(shingle)
                sets = [np.unique(found[lo:hi]).view(np.int64) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns[:-1], pa.array(sets, pa.list_(pa.int64()))], [*keep, "shingles"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[:-1], T.StructField("shingles", T.ArrayType(T.LongType()))]))


#: Bits of the marks of a text's shingles, and what puts a shingle last: so many of one sixteenth of the documents have it.
MARKS = 1024
COMMON = 32
MOST_COMMON = 1 << 16


def _common(docs: DataFrame, words: int) -> np.ndarray:
    """The most frequent shingles of a sample, sorted.  They decide in which order shingles are looked up, not what is found."""
    sample = shingle_sets(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(16)) == 0), words)
    count = sample.select(F.explode("shingles").alias("s")).groupBy("s").count().where(F.col("count") >= COMMON)
    found = count.orderBy(F.desc("count"), "s").limit(MOST_COMMON).toPandas()["s"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def _least(similarity: float, n):
    """How many of n shingles another text has at least, if it is so similar (float errors make it less, never more)."""
    return similarity * n - 1e-6


def prefixes(docs: DataFrame, words: int, similarity: float, common: np.ndarray, text: str = "text") -> DataFrame:
    """Adds n_shingles, ``marks`` (a bitmap of them), ``fine`` (one of two to four bits for each, ``MARKS`` at least) and ``prefix``.

    Texts that are similar enough have a shingle in common among the first
    ``n - ceil(similarity * n) + 1`` of both, in any order that all texts share.
    """
    keep = [c for c in docs.columns if c not in ("n_shingles", "marks", "fine", "prefix")]
    docs = docs.select(*[c for c in keep if c != text], text)
    keep = docs.columns[:-1]

    def bitmap(own: np.ndarray, size: int) -> np.ndarray:
        bits = np.zeros(size, np.uint8)
        bits[(own % np.uint64(size)).astype(np.int64)] = 1
        return np.packbits(bits, bitorder="little").view(np.int64)

    def run(batches):
        for batch in batches:
            for first, end, part in chunks(batch.column(len(keep)), lower=True):
                sizes, marks, fine, firsts = [], [], [], []
                found, bounds = part.shingles(words)
                for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = np.unique(found[lo:hi])
                    last = np.isin(own, common)
                    n = len(own) - int(np.ceil(_least(similarity, len(own)))) + 1 if len(own) else 0
                    sizes.append(len(own))
                    marks.append(bitmap(own, MARKS))
                    fine.append(bitmap(own, max(MARKS, 2 << (len(own) - 1).bit_length()) if len(own) else MARKS))
                    firsts.append(np.concatenate((own[~last], own[last]))[:n].view(np.int64))
                longs = pa.list_(pa.int64())
                new = [pa.array(sizes, pa.int64()), pa.array(marks, longs), pa.array(fine, longs), pa.array(firsts, longs)]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns, *new], [*keep, text, "n_shingles", "marks", "fine", "prefix"])

    added = "n_shingles long, marks array<long>, fine array<long>, prefix array<long>"
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *T._parse_datatype_string(added).fields]))


def _may_be_close(similarity: float, a: str = "a", b: str = "b", placed: bool = False, marked: bool = False):
    """False only where two texts cannot be similar enough, by sizes, by places of a common shingle, or by marks."""
    na, nb = F.col(f"{a}_n"), F.col(f"{b}_n")
    both = _least(similarity / (1 + similarity), na + nb)
    cond = F.least(na, nb) >= both
    if placed:  # true of their first common shingle
        cond = cond & (F.least(na - F.col(f"{a}_pos"), nb - F.col(f"{b}_pos")) >= both)
    if marked:  # each mark of one alone is of a shingle that the other lacks
        for x, y, n in ((a, b, na), (b, a, nb)):
            lone = sum((F.bit_count(F.col(f"{x}_marks")[i].bitwiseAND(F.bitwise_not(F.col(f"{y}_marks")[i]))) for i in range(MARKS // 64)), F.lit(0))
            cond = cond & (n - lone >= both)
    return cond


def _finely_close(similarity: float, a: str = "a", b: str = "b"):
    """As ``_may_be_close`` by marks, by the bitmaps that grow with the texts; the larger is folded to the size of the smaller."""
    x, y = F.col(f"{a}_fine"), F.col(f"{b}_fine")
    size = F.least(F.size(x), F.size(y))

    def folded(m):
        part = lambda i: F.aggregate(F.sequence(i, F.size(m), size), F.lit(0).cast("long"), lambda bits, j: bits.bitwiseOR(F.get(m, j - 1)))
        return F.when(F.size(m) == size, m).otherwise(F.transform(F.sequence(F.lit(1), size), part))

    x, y = folded(x), folded(y)
    lone = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: F.bit_count(i.bitwiseAND(F.bitwise_not(j)))), F.lit(0), lambda n, i: n + i)
    na, nb = F.col(f"{a}_n"), F.col(f"{b}_n")
    both = _least(similarity / (1 + similarity), na + nb)
    return (na - lone(x, y) >= both) & (nb - lone(y, x) >= both)


def _side(rows: DataFrame, c: str, *columns: str) -> DataFrame:
    names = {"node": c, "n_shingles": f"{c}_n"}
    return rows.select(*(F.col(x).alias(names.get(x, f"{c}_{x}")) for x in columns))


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) that share enough shingles.

    Marks of a fixed size say little of long texts, whose sets are the largest
    thing here to exchange; the fine bitmaps, some thirtieth of them, go first.
    """
    for c in "ab":
        pairs = pairs.join(_side(nodes, c, "node", "n_shingles", "fine").hint("merge"), c)
    pairs = written(pairs.where(_finely_close(similarity)).select("a", "b"), "finely-close")
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    named = nodes.join(named.hint("merge"), "node", "left_semi").select("node", F.col("rep.doc_id").alias("id"), F.col("rep.text_hash").alias("h"))
    texts = docs.withColumn("text_hash", F.xxhash64("text"))
    texts = texts.join(named.hint("shuffle_hash"), (texts["text_hash"] == named["h"]) & texts["doc_id"].eqNullSafe(named["id"]))
    sets = written(shingle_sets(texts.select("node", "text"), words).dropDuplicates(["node"]), "shingles")
    for c in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")).hint("merge"), c)
    both = F.size(F.array_intersect("a_set", "b_set"))
    close = written(pairs.where(both >= similarity * (F.size("a_set") + F.size("b_set") - both)).select("a", "b"), "close")
    removed(sets)
    return close


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 2, distance: int = 3, words: int = 5, similarity: float = 0.8
) -> DataFrame:
    """(doc_id, text_hash, component_id, kept) for every row of ``docs``: groups by confirmed links.

    Texts are linked if they share at least ``similarity`` of the ``words``-word
    shingles that either has; every such link counts.  Two rounds nominate.
    First, fingerprints of ``shingle`` words, linked by their first texts, and
    the first text with each shingle of the prefixes: few pairs, which join
    most of what belongs together.  Then all pairs with a common shingle in
    their prefixes that are not in one group yet, so none is missed.  Sizes,
    places and marks rule out most before whole sets are compared.

    text_hash is ``xxhash64`` of the text, for rows that repeat a doc_id.  kept
    is true for the row of each group with the smallest doc_id (nulls last), of
    these with the smallest text_hash; rows equal in both are kept or not
    together.  component_id is null where no row of the group has a doc_id.
    Texts without a word are one group.
    """
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc_id"), F.col(text).alias("text"))
    rows = prefixes(docs.withColumn("text_hash", F.xxhash64("text")), words, similarity, _common(docs, words))
    prints = written(fingerprints(rows, shingle), "fingerprints")
    firsts = [F.first(c).alias(c) for c in ("fp", "n_shingles", "marks", "fine", "prefix")]
    nodes = prints.groupBy(F.col("words_hash").alias("node")).agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), *firsts)
    nodes = written(nodes, "texts")

    heads = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    same = nodes.join(heads.hint("merge"), "fp").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    ends = [heads.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node")).hint("merge") for c in "ab"]
    cross = links(nodes, distance).join(ends[0], "a").join(ends[1], "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))

    posts = nodes.select("node", "n_shingles", F.posexplode("prefix").alias("pos", "s"))
    bucket = Window.partitionBy("s")
    lead = F.min(F.struct("n_shingles", "node", "pos")).over(bucket).alias("lead")
    held = posts.select("*", lead, F.count("*").over(bucket).alias("m")).where("m > 1").drop("m")
    held = written(held, "shared")
    stars = held.where("node != lead.node").select(
        F.col("lead.node").alias("a"), F.col("lead.n_shingles").alias("a_n"), F.col("lead.pos").alias("a_pos"),
        F.col("node").alias("b"), F.col("n_shingles").alias("b_n"), F.col("pos").alias("b_pos"),
    )
    pairs = same.union(cross).union(stars.where(_may_be_close(similarity, placed=True)).select("a", "b"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for c in "ab":
        pairs = pairs.join(_side(nodes, c, "node", "n_shingles", "marks").hint("merge"), c)
    pairs = written(pairs.where(_may_be_close(similarity, marked=True)).select("a", "b"), "nominated")
    close = _confirmed(pairs, nodes, docs, words, similarity)

    group = written(connected_components(close), "groups")
    held = held.drop("lead").join(group.hint("merge"), "node", "left").withColumn("group", F.coalesce("component", "node"))
    apart = held.groupBy("s").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo != hi").select("s")
    held = written(held.join(apart.hint("merge"), "s").join(nodes.select("node", "marks").hint("merge"), "node"), "apart")
    a, b = (_side(held, c, "s", "node", "n_shingles", "pos", "group", "marks") for c in "ab")
    others = (F.col("a_s") == F.col("b_s")) & (F.col("a") < F.col("b")) & (F.col("a_group") != F.col("b_group"))
    pairs = a.join(b.hint("merge"), others & _may_be_close(similarity, placed=True, marked=True)).select("a", "b").distinct()
    close = close.union(_confirmed(written(pairs, "nominated"), nodes, docs, words, similarity))

    group = connected_components(close)
    nodes = nodes.join(group.hint("merge"), "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    named = nodes.groupBy("component").agg(F.min("rep").alias("first"))
    names = nodes.join(named.hint("merge"), "component").select(F.col("node").alias("words_hash"), "first")
    out = prints.join(names.hint("merge"), "words_hash", "left")
    real = lambda c: F.when(F.col(c) != LAST, F.col(c))
    kept = F.struct("doc_id", "text_hash") == F.col("first")
    return out.select(real("doc_id").alias("doc_id"), "text_hash", real("first.doc_id").alias("component_id"), kept.alias("kept"))
