"""Language-model scores by deleted interpolation.

The model is P(w | v) = a2 c(v w) / c(v) + a1 c(w) / N + a0 / (V + 1), where v is
the token before w (or the start of the text) and the weights a depend on the
bucket, by powers of two, of c(v).  Weights are learned by expectation
maximisation on the counts of a part of the training documents that the counts
c leave out; the final model counts all of them.

Documents are dealt to blocks by a hash.  A block asks for the counts of its
distinct n-grams (64-bit hashes, sorted, in differences) and at the same time
gives its own; one row of the exchange holds what a block has in one range of
the hash space, so each range adds up sorted arrays, and a frequent n-gram has
one entry for each block at most.  Counts come back in the order of the question.

Defined results: null text is empty; an empty text is one end token; a null
doc_id counts as the empty string for the split; repeated rows count each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.shared import written
from kgspark.llm.text import chunks, got, mix, put

#: Bytes of text of a block, on average, and distinct keys of a range, about.
BLOCK_BYTES = 12 << 20
RANGE_KEYS = 3_000_000
CONTEXT_BUCKETS = 24
ROUNDS = 12
MAIN, EM, TEST = 0, 1, 2

_START, _END = (mix(np.array([i], np.uint64))[0] for i in (101, 102))
_PAIR = np.uint64(0x9FB21C651E98DF25)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, hashes of the tokens before, first token of each document and the end)."""
    token, before, counts = [], [], []
    for lo, hi, words in chunks(column, lower=True):
        n = words.counts + 1
        last = np.cumsum(n) - 1
        t = np.empty(int(n.sum()), np.uint64)
        inner = np.ones(len(t), bool)
        inner[last] = False
        t[inner] = words.hashes()
        t[last] = _END
        b = np.empty_like(t)
        b[1:] = t[:-1]
        b[last - n + 1] = _START
        token.append(t)
        before.append(b)
        counts.append(n)
    none = np.zeros(0, np.uint64)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return np.concatenate(token or [none]), np.concatenate(before or [none]), np.concatenate(([0], np.cumsum(n)))


_ODD = np.uint64(1)


def single(h: np.ndarray) -> np.ndarray:
    return h & ~_ODD


def pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + token) | _ODD


def places(token: np.ndarray, before: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Distinct keys, sorted; where each token, each pair and each context is among them; where the start is.

    Only distinct values are looked up, and a context is the token before, so two
    sorts of the tokens do for all three.
    """
    one, at_one = np.unique(single(token), return_inverse=True)
    two, at_two = np.unique(pair(before, token), return_inverse=True)
    keys = np.union1d(np.append(one, single(_START)), two)
    start = int(np.searchsorted(keys, single(_START)))
    of_token, of_pair = np.searchsorted(keys, one)[at_one], np.searchsorted(keys, two)[at_two]
    of_context = np.empty_like(of_token)
    of_context[1:] = of_token[:-1]
    of_context[first[:-1]] = start
    return keys, of_token, of_pair, of_context, start


def put_sorted(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences of six bytes, or of eight where one needs it."""
    step = np.diff(keys, prepend=keys[:1] * np.uint64(0))
    width = 6 if len(step) and int(step[1:].max(initial=0)) < 1 << 48 else 8
    head = np.array([width, keys[0] if len(keys) else 0], np.uint64).tobytes()
    return head + step[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def got_sorted(data: bytes) -> np.ndarray:
    width, first = np.frombuffer(data, np.uint64, 2)
    body = np.frombuffer(data, np.uint8, offset=16).reshape(-1, int(width))
    step = np.zeros((len(body) + 1, 8), np.uint8)
    step[1:, : int(width)] = body
    step = step.view(np.uint64).ravel()
    step[0] = first
    return np.cumsum(step, dtype=np.uint64)


def edges(ranges: int) -> np.ndarray:
    return np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)


def ask(table: pa.Table, ranges: int) -> pa.Table:
    """A block's keys with its counts in the main and the EM part, cut by range."""
    block = table.column("block")[0].as_py()
    token, before, first = tokens(_one(table.column("text")))
    part = _one(table.column("part")).to_numpy()
    of = np.repeat(part, np.diff(first))
    keys, of_token, of_pair, _, start = places(token, before, first)

    def counted(which: int) -> np.ndarray:
        mine = of == which
        out = np.bincount(of_token[mine], minlength=len(keys)) + np.bincount(of_pair[mine], minlength=len(keys))
        out[start] += np.count_nonzero(part == which)
        return out

    main, em = counted(MAIN), counted(EM)
    cut = np.concatenate(([0], np.searchsorted(keys, edges(ranges)), [len(keys)]))
    rows = [(block, r, put_sorted(keys[a:b]), put(main[a:b]), put(em[a:b])) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
    return _table(rows, [("block", pa.int32()), ("range", pa.int32()), ("keys", pa.binary()), ("main", pa.binary()), ("em", pa.binary())])


def answer(table: pa.Table) -> pa.Table:
    """Whole counts for each block of a range; block -1 has sums over the range in ``totals``."""
    asked = [got_sorted(x) for x in table.column("keys").to_pylist()]
    counts = [np.stack((got(a), got(b))) for a, b in zip(table.column("main").to_pylist(), table.column("em").to_pylist())]
    keys, place = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.zeros((2, len(keys)), np.int64)
    at = 0
    for c in counts:
        total[:, place[at : at + c.shape[1]]] += c  # a block asks once for each key
        at += c.shape[1]
    r = table.column("range")[0].as_py()
    rows, at = [], 0
    for block, c in zip(table.column("block").to_pylist(), counts):
        mine = total[:, place[at : at + c.shape[1]]]
        rows.append((block, r, put(mine[0]), put(mine[1]), None))
        at += c.shape[1]
    plain = (keys & _ODD == 0) & (keys != single(_START))
    main, em = total[0][plain], total[1][plain]
    rows.append((-1, r, None, None, [int(main.sum()), int((main > 0).sum()), int((main + em).sum()), int((main + em > 0).sum())]))
    kinds = [("block", pa.int32()), ("range", pa.int32()), ("main", pa.binary()), ("em", pa.binary()), ("totals", pa.list_(pa.int64()))]
    return _table(rows, kinds)


def looked_up(docs: pa.Table, answers: pa.Table):
    """(token counts, pair counts, context counts as rows main and em; first token of each document)."""
    token, before, first = tokens(_one(docs.column("text")))
    _, of_token, of_pair, of_context, _ = places(token, before, first)
    order = np.argsort(answers.column("range").to_numpy())
    pick = lambda c: np.concatenate([got(x) for x in answers.column(c).take(pa.array(order)).to_pylist()])
    counts = np.stack((pick("main"), pick("em")))
    return counts[:, of_token], counts[:, of_pair], counts[:, of_context], first


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the whole part of its binary logarithm."""
    return np.minimum(np.frexp(count.astype(float))[1], CONTEXT_BUCKETS - 1)


def held_out(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Distinct (c(v), c(v w), c(w)) of the EM part's tokens under the main counts, with their number."""
    w, vw, v, _ = looked_up(docs, answers)
    triples, n = np.unique(np.stack((v[0], vw[0], w[0]), 1), axis=0, return_counts=True)
    return pa.table({"v": triples[:, 0], "vw": triples[:, 1], "w": triples[:, 2], "n": n})


def learned(triples: DataFrame, n_main: int, v_main: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (a2, a1, a0) by context bucket, by expectation maximisation."""
    weights = np.tile([0.4, 0.5, 0.1], (CONTEXT_BUCKETS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    bucket = F.when(F.col("v") == 0, 0).otherwise(F.least(F.floor(F.log2("v")) + 1, F.lit(CONTEXT_BUCKETS - 1))).cast("int")
    p2 = F.when(F.col("v") > 0, F.col("vw") / F.col("v")).otherwise(0.0)
    rows = triples.select(bucket.alias("bucket"), p2.alias("p2"), (F.col("w") / max(1, n_main)).alias("p1"), "n")
    for _ in range(rounds):
        at = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in weights))[F.col("bucket")]
        parts = [at[0] * F.col("p2"), at[1] * F.col("p1"), at[2] / F.lit(float(v_main + 1))]
        whole = parts[0] + parts[1] + parts[2]
        sums = rows.groupBy("bucket").agg(*(F.sum(F.col("n") * p / whole).alias(f"e{i}") for i, p in enumerate(parts)))
        new = weights.copy()
        for row in sums.collect():  # a row for each of CONTEXT_BUCKETS at most
            e = np.array([row["e0"], row["e1"], row["e2"]])
            new[row["bucket"]] = (e + 1e-3) / (e + 1e-3).sum() if row["bucket"] else np.append(0.0, (e[1:] + 1e-3) / (e[1:] + 1e-3).sum())
        done = np.abs(new - weights).max() < 1e-4
        weights = new
        if done:
            break
    return weights


def scored(docs: pa.Table, answers: pa.Table, weights: np.ndarray, n: int, v: int) -> pa.Table:
    w, vw, context, first = looked_up(docs, answers)
    w, vw, context = w.sum(0), vw.sum(0), context.sum(0)
    a = weights[context_bucket(context)]
    p = a[:, 0] * vw / np.maximum(context, 1) + a[:, 1] * w / max(1, n) + a[:, 2] / (v + 1)
    base = np.log10((w + 0.5) / (n + 0.5 * (v + 1)))
    add = lambda x: np.add.reduceat(x, first[:-1])
    return pa.table(
        {
            "doc_id": _one(docs.column("doc_id")),
            "held_out": pa.array(_one(docs.column("part")).to_numpy() == TEST),
            "n_tokens": np.diff(first),
            "n_known": add((w > 0).astype(np.int64)),
            "train_tokens": np.full(docs.num_rows, n, np.int64),
            "base_score": add(base),
            "score": add(np.log10(p)),
        }
    )


def _one(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def _table(rows: list[tuple], kinds: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[n for n, _ in kinds])


def split_part(doc_id: str = "doc_id") -> Column:
    """TEST where crc32 of the doc_id as text leaves 1 modulo 5; of the rest, EM where it leaves 2 modulo 10."""
    crc = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return F.when(crc % 5 == 1, TEST).when(crc % 10 == 2, EM).otherwise(MAIN).cast("int")


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``part`` says which rows are MAIN, EM or TEST, ``split_part()`` unless given.
    Blocks hold rows of the EM part only, or none of it.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (split_part(doc_id) if part is None else part).alias("part"))
    size = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    blocks = max(8, math.ceil(size / BLOCK_BYTES))
    em_blocks = max(2, blocks // 8)
    ranges = max(12, math.ceil(size / 6 / RANGE_KEYS))
    block = F.when(F.col("part") == EM, blocks + F.pmod(F.xxhash64("doc_id", "text"), F.lit(em_blocks))).otherwise(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
    )
    rows = rows.withColumn("block", block.cast("int"))
    asked = rows.groupBy("block").applyInArrow(lambda t: ask(t, ranges), "block int, range int, keys binary, main binary, em binary")
    answers = asked.groupBy("range").applyInArrow(answer, "block int, range int, main binary, em binary, totals array<long>")
    answers = written(answers, "answers")
    sums = answers.where("block = -1").select(*(F.sum(F.col("totals")[i]) for i in range(4))).first()
    n_main, v_main, n, v = (int(x or 0) for x in sums)
    answers = answers.where("block >= 0").select("block", "range", "main", "em")
    in_em = F.col("block") >= blocks
    triples = rows.where(F.col("part") == EM).groupBy("block").cogroup(answers.where(in_em).groupBy("block"))
    triples = triples.applyInArrow(held_out, "v long, vw long, w long, n long").groupBy("v", "vw", "w").agg(F.sum("n").alias("n"))
    weights = learned(written(triples, "triples"), n_main, v_main)
    out = rows.groupBy("block").cogroup(answers.groupBy("block"))
    return out.applyInArrow(
        lambda d, a: scored(d, a, weights, n, v),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
