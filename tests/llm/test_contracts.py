"""Operators against brute force on a table with nulls, empties, ties, copies, long texts and clashing columns."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from kgspark.llm import byte_bpe, exact_dedup, language_model, quality, simhash, substring, token_counts
from tests.llm.helpers import SCHEMA, documents, lower, rows, texts, words


def test_statistics(spark):
    got = rows(quality.statistics(documents(spark)).select("doc_id", *quality.STATS, "base_failed"))
    want = []
    for d, t in texts():
        w = words(t)
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        count = Counter(windows)
        covered = {i + j for i, x in enumerate(windows) if count[x] > 1 for j in range(5)}
        bad = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(covered), bad))
    assert got == sorted(want, key=repr)


def test_quality_keeps_clean_rows_and_rejects_outliers(spark):
    import random

    rng = random.Random(1)
    vocab = [chr(97 + i) * (3 + i % 5) for i in range(26)]
    clean = [(i, " ".join(rng.choice(vocab) + str(rng.randint(0, 9999)) for _ in range(rng.randint(40, 200)))) for i in range(200)]
    odd = [(1000, " ".join(f"{i}#$%&|<>#" for i in range(100))), (1001, " ".join("q" * 200 + str(i) for i in range(100)))]
    table = spark.createDataFrame([(d, t, "en", "s") for d, t in clean + odd], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality.quality(table).collect()}
    assert all(got[d] for d, _ in clean)
    assert not got[1000] and not got[1001]


def test_quality_small_and_null_groups(spark):
    got = quality.quality(documents(spark))
    assert got.count() == len(texts())
    assert {r["kept"] for r in got.where("base_failed").collect()} == {False}
    assert got.where("kept IS NULL").count() == 0


def test_quality_small_groups_are_judged_by_coarser_ones(spark):
    import random

    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randint(1000, 9999)}" for _ in range(rng.randint(60, 90)))
    junk = " ".join(f"{i}#$%&|<>#{'q' * 200}" for i in range(100))
    data = [(i, text(), "en", "big") for i in range(40)] + [(100 + i, text(), "en", f"site{i}") for i in range(10)] + [(200, text(), "fr", None)]
    data += [(300, junk, "en", "site3"), (301, junk, "fr", None), (302, junk, "de", "x")]
    table = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.quality(table).collect()}
    assert {d for d, r in got.items() if not r["kept"]} == {300, 301, 302}
    assert all(r["distance2"] is not None for r in got.values())
    few = {r["doc_id"]: r["distance2"] for r in quality.quality(table.where("doc_id >= 108")).collect()}
    assert len(few) == 6 and None not in few.values()


def test_quality_each_statistic_can_reject_alone(spark):
    import random

    rng = random.Random(6)
    word = lambda n=4: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    text = lambda n, size=4: [word(size) for _ in range(n)]
    passage = text(9)
    odd = {
        900: text(100, 12), 901: text(2500), 902: [w[1:] + "#" if i % 4 == 0 else w for i, w in enumerate(text(100))],
        903: [x for _ in range(19) for x in (*text(4), "\n", "last", "\n")], 904: [*text(40), *passage, *text(42), *passage],
    }
    data = [(i, " ".join(text(rng.randint(80, 120)))) for i in range(200)] + [(d, " ".join(t)) for d, t in odd.items()]
    table = spark.createDataFrame([(d, t, "en", "s") for d, t in data], "doc_id long, text string, lang string, source string")
    got = quality.quality(table).collect()
    assert not [r["doc_id"] for r in got if r["base_failed"]]
    assert {r["doc_id"] for r in got if not r["kept"]} == set(odd)
    plain = [100, 400, 0, 0, 0]
    for k, d in enumerate([1, 0, 2, 3, 4]):
        one = next(r for r in got if r["doc_id"] == 900 + k)
        others = [i for i in range(2, 5) if i != d]
        assert all(one[quality.STATS[i]] == plain[i] for i in others)


def test_concentration_reaches_a_lower_determinant(spark):
    """The robust scatter ignores a third of far rows that the plain one follows."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(0, 1, (300, 5)), rng.normal(20, 1, (140, 5))))
    table = spark.createDataFrame([(*map(int, r * 1024), "en", "s") for r in x], "x0 long, x1 long, x2 long, x3 long, x4 long, lang string, source string")
    fit = quality.outliers(table).first()
    assert all(abs(c / 1024) < 0.5 for c in fit["centre"])
    far = table.join(quality.outliers(table), table["lang"].eqNullSafe(F.col("_lang"))).where(quality._distance() > quality.CHI2_CUT).count()
    assert far == 140


def test_exact_dedup(spark):
    import re

    got = rows(exact_dedup.exact_dedup(documents(spark)))
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in texts()]
    groups = {}
    for d, t in norm:
        groups.setdefault(t, []).append(d)
    want = []
    for d, t in norm:
        keep = min((x for x in groups[t] if x is not None), default=None)
        want.append((d, keep, len(groups[t]), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1 << 60, 3000, dtype=np.uint64) | np.uint64(5) << np.uint64(60)
    drawn = [rng.choice(values, 4000) for _ in range(3)]
    filters = []
    for d in drawn:
        v, c = np.unique(d, return_counts=True)
        f = exact_dedup.QuotientFilter(4, 5, v, c, 9)
        filters.append(exact_dedup.QuotientFilter.load(f.dump()))
        assert (f.items()[0] == v).all() and (f.items()[1] == c).all()
    v, c = exact_dedup.QuotientFilter.merge(filters).items()
    want, counts = np.unique(np.concatenate(drawn), return_counts=True)
    assert (v == want).all() and (c == counts).all()


def _fingerprint(text, n):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    data = texts()
    prints = [_fingerprint(t, 3) for _, t in data]
    parent = list(range(len(data)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    want = []
    for i, (d, _) in enumerate(data):
        ids = [data[j][0] for j in range(len(data)) if find(j) == find(i) and data[j][0] is not None]
        want.append((d, f"{prints[i]:016x}", min(ids, default=None)))
    from pyspark.sql import functions as F

    got = simhash.near_dedup(documents(spark)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_multi_index_finds_every_link(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 1 << 63, 30, dtype=np.int64)
    values = {int(b) for b in base}
    for b in base:
        for k in range(6):
            for bit in rng.choice(63, k, replace=False):
                b ^= np.int64(1) << np.int64(bit)
            values.add(int(b))
    values = sorted(values) + [0, -1]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), distance).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for a in values for b in values if a < b and ((a & mask) ^ (b & mask)).bit_count() <= distance}
    assert got == want


def test_token_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    table, byte = token_counts.scores(token_counts.read_pieces(path))
    longest = max(map(len, table))

    def count(word):
        word = "▁" + word
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            size = len(word[i - 1].encode())
            found = [(best[i - 1][0] + size * byte, best[i - 1][1] + size)]
            found += [(best[j][0] + table[word[j:i]], best[j][1] + 1) for j in range(max(0, i - longest), i) if word[j:i] in table]
            best.append(max(found, key=lambda x: (x[0], -x[1])))
        return best[-1][1]

    memo = {}
    want = []
    for d, t in texts():
        w = words(t)
        want.append((d, len(w), sum(memo.setdefault(x, count(x)) if x not in memo else memo[x] for x in w)))
    got = token_counts.count_tokens(documents(spark), path).select("doc_id", "n_words", "n_tokens")
    assert rows(got) == sorted(want, key=repr)


def _model(data):
    """Counts, weights and scores of the deleted interpolation, on the whole in one place."""
    part, toks = [], []
    for d, t in data:
        crc = zlib.crc32(("" if d is None else str(d)).encode())
        part.append("test" if crc % 5 == 1 else "em" if crc % 10 == 2 else "main")
        toks.append([*words(lower(t)), "</s>"])
    one, two, ctx = ({p: Counter() for p in ("main", "em", "test")} for _ in range(3))
    for p, w in zip(part, toks):
        one[p].update(w)
        two[p].update(zip(["<s>", *w], w))
        ctx[p].update(["<s>", *w[:-1]])
    size = language_model.CONTEXT_BUCKETS
    bucket = lambda c: 0 if c == 0 else min(int(math.log2(c)) + 1, size - 1)
    weights = [[0.0, 0.9, 0.1]] + [[0.4, 0.5, 0.1]] * (size - 1)
    n, v = sum(one["main"].values()), len(one["main"])
    # Contexts are counted as tokens, wherever they stand, and once for each start.
    c1 = lambda ps, x: sum(one[p][x] for p in ps) if x != "<s>" else sum(ctx[p][x] for p in ps)
    for _ in range(language_model.ROUNDS):
        e = [[0.0] * 3 for _ in range(size)]
        for (a, b), k in two["em"].items():
            ca = c1(["main"], a)
            w = weights[bucket(ca)]
            p = [w[0] * (two["main"][a, b] / ca if ca else 0), w[1] * one["main"][b] / max(1, n), w[2] / (v + 1)]
            for i in range(3):
                e[bucket(ca)][i] += k * p[i] / sum(p)
        new = []
        for i, x in enumerate(e):
            if not sum(x):
                new.append(weights[i])
            elif i:
                new.append([(y + 1e-3) / (sum(x) + 3e-3) for y in x])
            else:
                new.append([0.0] + [(y + 1e-3) / (x[1] + x[2] + 2e-3) for y in x[1:]])
        done = max(abs(p - q) for x, y in zip(new, weights) for p, q in zip(x, y)) < 1e-4
        weights = new
        if done:
            break
    ps = ["main", "em"]
    n = sum(sum(one[p].values()) for p in ps)
    v = len(one["main"] + one["em"])
    out = []
    for (d, _), p, w in zip(data, part, toks):
        score = base = known = 0
        for a, b in zip(["<s>", *w], w):
            ca, cb = c1(ps, a), c1(ps, b)
            x = weights[bucket(ca)]
            score += math.log10(x[0] * (sum(two[q][a, b] for q in ps) / ca if ca else 0) + x[1] * cb / max(1, n) + x[2] / (v + 1))
            base += math.log10((cb + 0.5) / (n + 0.5 * (v + 1)))
            known += cb > 0
        out.append((d, p == "test", len(w), known, n, round(base, 6), round(score, 4)))
    return out


def test_language_model(spark):
    from pyspark.sql import functions as F

    got = language_model.score_documents(documents(spark))
    got = got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6), F.round("score", 4))
    want = sorted(_model(texts()), key=repr)
    assert len(rows(got)) == len(want)
    for g, w in zip(rows(got), want):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=2e-5) and g[6] == pytest.approx(w[6], rel=1e-4, abs=1e-3)


def test_substring_dedup(spark):
    data = texts()
    first = {}
    for d, t in sorted(data, key=lambda x: (x[0] is None, x[0] or 0)):
        w = words(t)
        k = substring.LAST if d is None else d
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (k, i))
            first[tuple(w[i : i + 20])] = min(first[tuple(w[i : i + 20])], (k, i))
    want = []
    for d, t in data:
        w = words(t)
        k = substring.LAST if d is None else d
        gone = {i + j for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] < (k, i) for j in range(20)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    from pyspark.sql import functions as F

    got = substring.substring_dedup(documents(spark)).select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept_sha")))
    assert rows(got) == sorted(want, key=repr)


def test_byte_bpe(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = [(90, "<|endoftext|> is text"), (91, "word  " * 30000 + "\n\n tail"), (92, "ab " * 40000)]
    docs = documents(spark, texts() + extra)
    ids = byte_bpe.encode(docs, path, public_tokenizers.PATTERN)
    got = rows(byte_bpe.digests(byte_bpe.decode(ids, path, public_tokenizers.PATTERN)))
    want = []
    for d, t in texts() + extra:
        i = enc.encode_ordinary(t or "")
        want.append((d, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_byte_bpe_blank_runs(spark):
    """A run of blanks of any length round-trips."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    text = "a" + " " * 20000 + "b\n" + "\n" * 9000
    enc = byte_bpe.encoding(byte_bpe.read_ranks(path), public_tokenizers.PATTERN)
    assert enc.decode(byte_bpe.encode_text(enc, text)) == text


@pytest.mark.parametrize("run", [
    lambda d: quality.quality(d), lambda d: exact_dedup.exact_dedup(d), lambda d: simhash.near_dedup(d), lambda d: simhash.near_duplicates(d),
    lambda d: token_counts.count_tokens(d, public_tokenizers.path("piece_bpe_32k.model")), lambda d: language_model.score_documents(d),
    lambda d: substring.substring_dedup(d), lambda d: byte_bpe.encode(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
