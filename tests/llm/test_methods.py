"""Secret scan, line dedup, packing, near duplicates, and the pipeline."""

import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kgspark.llm import line_dedup, packing, secrets, shared, simhash
from tests.llm.helpers import SCHEMA, documents, lower, plain, prose, rows, texts

# Secret scan.


def test_forest_on_held_out_findings(spark):
    words = spark.createDataFrame([(w, 9) for w in "station letter winter garden forest harbour market paper window commit token".split()], "word string, n long")
    table = secrets.transitions(words)
    labelled = secrets.labelled_findings(spark, 4000)
    train, test = labelled.where("xxhash64(candidate) % 4 != 0"), labelled.where("xxhash64(candidate) % 4 = 0")
    got = secrets.verdicts(test, secrets.train(train, words, table), words, table)
    right = got.where("is_secret = (label = 1)").count() / got.count()
    assert right > 0.95


def test_scan_finds_secrets_and_leaves_prose(spark):
    rng = random.Random(2)
    secret = "aZ3kQ9xT7bL2mW8vR5yN1cJ6dH4sF0gP"
    data = [(i, prose(rng, 60), "src1") for i in range(30)]
    data += [(100, f'config api_key = "{secret}" end', "app/.env"), (101, "the extraordinarilylongcompoundword here", "docs"), (102, None, None), (103, "", "x")]
    found = secrets.scan(plain(spark, data)).where("is_secret").select("doc_id", "candidate").collect()
    assert [tuple(r) for r in found] == [(100, secret)]


def test_findings_positions(spark):
    text = "a token=ABCDEFGHIJKLMNOPQR,0123456789abcdefXY b ABCDEFGHIJKLMNOPQR"
    found = secrets.findings(plain(spark, [(1, text), (1, text), (2, 'the pwd: "hunter2!" and so on')]))
    got = rows(found.select("doc_id", "nth", "candidate", "before", "after"))
    one = [
        (1, 0, "ABCDEFGHIJKLMNOPQR", "a token=", ","),
        (1, 1, "0123456789abcdefXY", "a token=ABCDEFGHIJKLMNOPQR,", " b"),
        (1, 2, "ABCDEFGHIJKLMNOPQR", "token=ABCDEFGHIJKLMNOPQR,0123456789abcdefXY b ", ""),
    ]
    assert got == sorted(one * 2 + [(2, 0, "hunter2!", 'the pwd: "', '" and')], key=repr)


def test_transitions_of_short_and_very_long_candidates(spark):
    """The mean log probability by hand, and a run of 5 MB in a few seconds."""
    import random

    rng = random.Random(8)
    words = spark.createDataFrame([("river", 5), ("stone", 9)], "word string, n long")
    table = secrets.transitions(words)
    signs = "abcXYZ019+/_-é😀"
    short = ["".join(rng.choice(signs) for _ in range(rng.randint(6, 40))) for _ in range(30)]
    long = "".join(rng.choice(signs[:13]) for _ in range(5_000_000))
    rows = lambda cs: spark.createDataFrame([(c, "p", "b", "a") for c in cs], "candidate string, path string, before string, after string")
    at = lambda c: secrets.ALPHABET.index("0" if c in "0123456789" else c.lower() if c.lower() in secrets.ALPHABET[:26] else "-")
    for r in secrets.features(rows(short), words, table).select("candidate", "transition").collect():
        c = r["candidate"]
        assert abs(r["transition"] - sum(table[at(a) * 28 + at(b)] for a, b in zip(c, c[1:])) / (len(c) - 1)) < 1e-9
    began = time.time()
    found = secrets.features(rows([long]), words, table).select(*secrets.FEATURES).first()
    assert time.time() - began < 60 and found["length"] > 22


def test_redaction_is_by_place(spark):
    """Only the places that were found change, of rows with their doc_id and text; columns of any name stay."""
    key = "KEYKEYKEYKEYKEYKEY1"
    data = [(1, f"x {key} y {key}2 z {key}"), (1, f"n {key}"), (2, None), (None, f"n {key}"), (None, f"n {key}")]
    docs = documents(spark, data).withColumnRenamed("k", "_found").withColumnRenamed("fp", "_doc")
    found = secrets.findings(docs).withColumn("is_secret", F.expr("nth != 1 AND (doc_id IS NULL OR nth = 2)"))
    got = secrets.redacted(docs, found)
    assert {"_found", "_doc"} <= set(got.columns)
    want = [(1, f"x {key} y {key}2 z {secrets.MARK}"), (1, f"n {key}"), (2, None), (None, f"n {secrets.MARK}"), (None, f"n {secrets.MARK}")]
    assert rows(got.select("doc_id", "text")) == sorted(want, key=repr)


def test_scores_do_not_depend_on_partitions(spark):
    words = spark.createDataFrame([(w, 9) for w in "station letter winter garden".split()], "word string, n long")
    table = secrets.transitions(words)
    labelled = secrets.labelled_findings(spark, 600)
    found = labelled.drop("label").limit(50)
    scores = [rows(secrets.verdicts(found, secrets.train(labelled.repartition(n), words, table), words, table).select("candidate", "before", "score")) for n in (1, 3)]
    assert scores[0] == scores[1]


PLANTED = [
    'AWS_SECRET_ACCESS_KEY={0}', 'curl -H "Authorization: token {0}"', 'jdbc.password = "{1}"', "db: {{user: root, pwd: '{1}'}}", 'export API_KEY={0}',
    'client_secret: {0}', 'set token = "{2}" here', "credential = `{2}`",
]
HARMLESS = [
    "the checksum sha256: {3} of the file", "commit {4} by hand", "enter your password: carefully and wait", "token: <your_token_here>",
    "the antidisestablishmentarianism of incomprehensibilities", "see https-www-example-org-some-long-page-name for more", "secret: ${{VAULT_SECRET}}", "number 1234567890123456 of it",
]


def test_planted_secrets(spark):
    """Forms of their own, not those of the labelled findings: nine of ten planted secrets are found, and nine of ten findings are right."""
    rng = random.Random(9)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    data = []
    for i in range(160):
        form = (PLANTED + HARMLESS)[i % 16]
        fill = form.format(draw(letters, 32), draw(letters + "!#$%", 10) + "7$", "xoxb-" + draw(letters, 24), draw("0123456789abcdef", 64), draw("0123456789abcdef", 40))
        data.append((i, f"{prose(rng, 20)} {fill} {prose(rng, 20)}", "src1"))
    got = secrets.scan(plain(spark, data)).where("is_secret").select("doc_id").distinct().collect()
    found = {r["doc_id"] for r in got}
    true = {i for i in range(160) if i % 16 < 8}
    assert len(found & true) >= 0.9 * len(true) and len(found & true) >= 0.9 * len(found)


def test_scan_of_any_table(spark):
    secrets.scan(documents(spark)).count()
    assert secrets.scan(spark.createDataFrame([], SCHEMA)).count() == 0


# Line dedup.


def test_patience_aligns_common_subsequences():
    rng = random.Random(7)
    for _ in range(300):
        a = [rng.randint(0, 6) for _ in range(rng.randint(0, 14))]
        b = [rng.randint(0, 6) for _ in range(rng.randint(0, 14))]
        got = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert line_dedup.patience(list(range(50)), list(range(50))) == [(i, i) for i in range(50)]


BLOCK = "This first line is a part of the passage that is shared.\nAnd so is this second line, which makes it long enough."


def test_shared_blocks_leave_the_later_document(spark):
    data = [(1, f"own one\n{BLOCK}\nend one"), (2, f"own two\n\n{BLOCK}\nend two"), (3, "own three\nend one\nshort"), (4, None), (5, ""), (6, BLOCK), (6, BLOCK)]
    got = rows(line_dedup.line_dedup(plain(spark, data)).select("doc_id", "n_lines", "n_removed", "text"))
    want = [(1, 4, 0, data[0][1]), (2, 5, 2, "own two\n\nend two"), (3, 3, 0, data[2][1]), (4, 0, 0, None), (5, 1, 0, ""), (6, 2, 2, ""), (6, 2, 2, "")]
    assert got == sorted(want, key=repr)


def test_clean_and_odd_documents_stay(spark):
    got = line_dedup.line_dedup(documents(spark))
    assert got.count() == len(texts())
    kept = {(r["doc_id"], r["text"]) for r in got.where("n_removed = 0").collect()}
    assert {x for x in texts() if x[0] in (1, 2, 3, 4, 5, 70)} <= kept
    assert line_dedup.line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_frequent_line_makes_one_pair_for_each_document(spark):
    data = [(i, f"common line\nown {i} " + "z" * 120) for i in range(60)]
    assert line_dedup.line_dedup(plain(spark, data)).where("n_removed > 0").count() == 0


def _removed(data, min_chars=100):
    """Lines in consecutive worded lines of enough characters that an earlier document has, by all pairs of places."""
    docs = [[(i, x) for i, x in enumerate(t.split("\n")) if x.strip(" \t\n\v\f\r")] for _, t in data]
    out = []
    for k, mine in enumerate(docs):
        gone = set()
        for theirs in docs[:k]:
            for p in range(len(theirs)):
                for q in range(len(mine)):
                    n = 0
                    while p + n < len(theirs) and q + n < len(mine) and theirs[p + n][1] == mine[q + n][1]:
                        n += 1
                    if sum(len(x) for _, x in mine[q : q + n]) >= min_chars:
                        gone |= {i for i, _ in mine[q : q + n]}
        out.append(gone)
    return out


def test_blocks_put_together_from_lines_of_others(spark):
    one, two, tail = "a first line of some sixty characters that A has before all", "a second line of some sixty characters, and B has it first", "tail"
    data = [(1, f"{one}\nown a"), (2, f"{two}\nown b"), (3, f"own c\n{one}\n{two}\n{tail}"), (4, f"{one}\n{two}\n{tail}\nown d")]
    rng = random.Random(31)
    pool = [prose(rng, rng.randint(1, 9)) for _ in range(12)]
    data += [(10 + i, "\n".join(rng.choice([*pool, "", f"own {i} {rng.random()}"]) for _ in range(rng.randint(3, 14)))) for i in range(40)]
    want = _removed(data)
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(plain(spark, data)).collect()}
    assert got == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone) for (d, t), gone in zip(data, want)}
    assert got[4] == "own d" and sum(map(bool, want)) >= 10


def test_alignment_decides():
    """A moved block goes with the second alignment; single lines of a crossing are too short; repeated lines need their run aligned by itself."""
    lines = lambda x: [(p, ord(c), 40) for p, c in enumerate(x)]

    def go(a, b, upto=None):
        there = [[p for p, c in enumerate(a) if ord(c) == k] for k in range(128)]
        found = line_dedup.aligned_runs(there, lines(b), upto, 100) if upto else line_dedup.aligned_places(there, lines(b), 100)
        return "".join(b[p] for p in found)

    assert go("xabcdy", "pabcdq") == "abcd"
    assert go("abcdefg", "efgabcd") == "efgabcd"
    assert go("abxcdyef", "abpcdqef") == ""
    assert go("abcxaby", "cabcaby") == "abcaby"
    assert go("ababaqab", "xabay") == "" and go("ababaqab", "xabay", {1: 4}) == "aba"
    # Long texts of few lines, none of them unique, with an edit in every hundred: runs decide, and end soon.
    rng = random.Random(3)
    a = [rng.randrange(30) for _ in range(40_000)]
    b = [k if i % 100 else 30 for i, k in enumerate(a)]
    there = [[p for p, k in enumerate(a) if k == x] for x in range(31)]
    upto = {i: i + 10 for i in range(len(b) - 9) if 30 not in b[i : i + 10]}
    began = time.time()
    assert len(line_dedup.aligned_runs(there, [(p, k, 10) for p, k in enumerate(b)], upto, 100)) == 99 * 400 and time.time() - began < 60


# Packing.


def _best_fit(lengths, sources, clusters, capacity, per_source):
    bins, out = [], [-1] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [
            (capacity - sum(lengths[j] for j in b), k) for k, b in enumerate(bins)
            if capacity - sum(lengths[j] for j in b) >= lengths[i]
            and (clusters[i] < 0 or clusters[i] not in [clusters[j] for j in b])
            and (sources[i] < 0 or sum(sources[j] == sources[i] for j in b) < per_source)
        ]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        bins[k].append(i)
        out[i] = k
    return out


def test_best_fit_is_the_tightest_compatible_bin():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(0, 60)
        args = [rng.randint(1, 30) for _ in range(n)], [rng.randint(-1, 4) for _ in range(n)], [rng.randint(-1, 6) for _ in range(n)]
        assert packing.best_fit(*args, 30, 2) == _best_fit(*args, 30, 2)


def _packed(docs):
    return packing.clustered(docs).withColumn("n_tokens", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))


def test_packing_keeps_every_token_and_every_constraint(spark):
    docs = _packed(documents(spark))
    got = packing.pack(docs, capacity=256, shard_rows=8)
    want = {r[0]: r[1] for r in docs.groupBy(F.coalesce("doc_id", F.lit(-99))).agg(F.sum("n_tokens")).collect()}
    have = {r[0]: r[1] for r in got.groupBy(F.coalesce("doc_id", F.lit(-99))).agg(F.sum("n_tokens")).collect()}
    assert want == have
    assert got.groupBy("bin_id").agg(F.sum("n_tokens").alias("n")).where("bin_id IS NOT NULL AND n > 256").count() == 0
    part = got.where("n_tokens < 256 AND bin_id IS NOT NULL").join(docs.dropDuplicates(["doc_id"]).select("doc_id", "source", "cluster"), "doc_id")
    assert part.groupBy("bin_id", "cluster").count().where("count > 1").count() == 0
    assert part.where("source IS NOT NULL").groupBy("bin_id", "source").count().where("count > 2").count() == 0
    assert packing.pack(_packed(spark.createDataFrame([], SCHEMA))).count() == 0


def test_packing_equals_brute_force_by_shard(spark):
    """Each shard of the query's operator is best-fit as the plain search does it, longest first, ties by doc_id."""
    docs = _packed(documents(spark))
    got = packing.pack(docs, capacity=256, shard_rows=10_000)
    source = {s: i for i, s in enumerate(["s1", "s2"])}
    held = sorted(docs.select("doc_id", "n_tokens", "source", "cluster").collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]))
    rest = [r for r in held if r["n_tokens"] % 256]
    codes = {c: i for i, c in enumerate(dict.fromkeys(r["cluster"] for r in held))}
    bins = _best_fit([r["n_tokens"] % 256 for r in rest], [source.get(r["source"], -1) for r in rest], [codes[r["cluster"]] for r in rest], 256, 2)
    full = sum(r["n_tokens"] // 256 for r in held)
    assert got.where("bin_id IS NOT NULL").select("bin_id").distinct().count() == len(set(bins)) + full


def test_sequences_hold_every_token_in_order(spark):
    rng = random.Random(8)
    data = [(i % 30 if i % 7 else None, [rng.randint(0, 9) for _ in range(rng.choice([0, 3, 20, 70]))], f"s{i % 3}") for i in range(60)] * 2
    docs = spark.createDataFrame([(d, t, s, i % 50) for i, (d, t, s) in enumerate(data)], "doc_id long, ids array<int>, source string, cluster long")
    got = packing.sequences(docs, capacity=32, shard_rows=16).collect()
    assert all(r["n_tokens"] == len(r["ids"]) <= 32 and len(r["doc_ids"]) == len(r["starts"]) for r in got)
    pieces = [(d, tuple(r["ids"][a:b])) for r in got for d, a, b in zip(r["doc_ids"], r["starts"], [*r["starts"][1:], r["n_tokens"]])]
    want = [(d, tuple(t[i : i + 32])) for d, t, _ in data for i in range(0, len(t), 32)]
    assert sorted(pieces, key=repr) == sorted(want, key=repr)
    assert packing.sequences(docs.limit(0)).count() == 0


def test_sequences_do_not_depend_on_partitions(spark):
    rows = [(d % 150 if d % 10 else None, f"s{d % 3}", d % 40, [d % 150] * (d % 150 % 23)) for d in range(600)]
    rows += [(7, "s1", 7, [7, 7, 7])] * 200
    docs = spark.createDataFrame(rows, "doc_id long, source string, cluster long, ids array<int>")
    again = spark.createDataFrame(rows[::-1], docs.schema)
    out = [sorted(map(tuple, packing.sequences(df, capacity=64, shard_rows=50).toPandas().map(lambda x: tuple(x) if hasattr(x, "__len__") else x).itertuples(index=False)), key=repr) for df in (docs.repartition(3), again.repartition(7), docs.coalesce(1))]
    assert out[0] == out[1] == out[2]
    held = sorted(t for r in out[0] for t in r[2])
    assert held == sorted(t for r in rows for t in r[3])


# Near duplicates.


def test_near_duplicates_need_shared_shingles(spark):
    rng = random.Random(9)
    a = prose(rng, 400)
    near = a.split()
    near[200] = "changed"
    data = [(1, a), (2, " ".join(near)), (3, a.upper()), (4, prose(rng, 400)), (5, None), (6, ""), (7, a), (7, a)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(plain(spark, data)).collect()}
    assert got[2] == got[7] == 1 and got[4] == 4
    assert got[6] == got[5] == 5


def _near_groups(data, similarity=0.8):
    """The smallest doc_id that links reach, for each row (doc_id, text), by all pairs."""
    sets = []
    for _, t in data:
        w = lower(t).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                group = [group[j] if g == group[i] else g for g in group]
    return [min(d for (d, _), h in zip(data, group) if h == g) for g in group]


def _changed(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"other{rng.randint(0, 10**9)}"
    return " ".join(w)


def test_near_duplicates_miss_no_pair(spark):
    rng = random.Random(21)
    data = []
    for k in range(40):
        base = prose(rng, rng.randint(30, 300))
        data += [(10 * k, base), *((10 * k + j, _changed(rng, base, max(1, len(base.split()) * j // 100))) for j in range(1, 6))]
    data += [(1000 + i, f"{BLOCK} {prose(rng, 60)}") for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(plain(spark, data)).collect()}
    want = dict(zip([d for d, _ in data], _near_groups(data)))
    assert got == want
    assert sum(d != c for d, c in want.items()) > 60


def test_near_duplicates_beyond_the_first_text_of_a_fingerprint(spark, monkeypatch):
    # One fingerprint for all: the first text is like neither of two that are alike.
    monkeypatch.setattr(simhash, "fingerprints", lambda d, *_: d.select(*[c for c in d.columns if c != "text"], F.lit(0).cast("long").alias("fp"), F.xxhash64("text").alias("words_hash")))
    rng = random.Random(22)
    pairs = [prose(rng, 200) for _ in range(6)]
    data = [(1, prose(rng, 200)), *((10 + i, t) for i, t in enumerate(pairs)), *((20 + i, _changed(rng, t, 2)) for i, t in enumerate(pairs))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(plain(spark, data)).collect()}
    assert got == {1: 1} | {10 + i: 10 + i for i in range(6)} | {20 + i: 10 + i for i in range(6)}


def test_near_stage_tells_texts_of_one_doc_id_apart(spark):
    rng = random.Random(23)
    a, b = prose(rng, 100), prose(rng, 100)
    data = [(1, a), (2, _changed(rng, a, 1)), (2, b)]
    left = corpus_pipeline.near_stage(spark, plain(spark, data), None)
    assert rows(left.select("doc_id", "text")) == sorted([(1, a), (2, b)], key=repr)


# The pipeline.


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    secret = "aZ3kQ9xT7bL2mW8vR5yN1cJ6dH4sF0gP"
    vocab = [chr(97 + i) + chr(101 + i % 7) + "n" * (i % 4) + "t" for i in range(24)]
    clean = lambda n: "\n".join(" ".join(rng.choice(vocab) + str(rng.randint(0, 99)) for _ in range(12)) for _ in range(n))
    data = [(i, clean(8), "web") for i in range(60)]
    data += [(100, data[0][1], "web"), (101, data[1][1].upper(), "web"), (102, "too short", "web"), (103, clean(4) + f'\napi_key = "{secret}"\n' + clean(4), "web"), (104, None, None), (105, "", None)]
    docs = plain(spark, data)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "secret scans", "best-fit packing"]
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns, name
    ids = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert ids == set(range(60)) | {103}
    text = out.where("doc_id = 103").first()["text"]
    assert secret not in text and secrets.MARK in text
    packed = corpus_pipeline.run(spark, str(tmp_path))
    bins = packed.collect()
    assert {d for r in bins for d in r["doc_ids"]} == ids
    assert all(len(r["ids"]) == r["n_tokens"] <= 2048 for r in bins)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_any_table(spark, tmp_path, stage):
    docs = documents(spark)
    stage(spark, docs, str(tmp_path)).count()
    assert stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0


def test_line_dedup_leaves_other_columns_alone(spark):
    """Columns with the names used inside, null and empty texts, and four documents whose block has different first holders."""
    a, b = "the first line of a block that two documents share, sixty on", "and the second one, of sixty characters or so as well, too"
    data = [(1, f"{a}\nx one"), (2, f"y two\n{b}"), (3, f"{a}\n{b}\nthree"), (4, f"four\n{a}\n{b}"), (None, None), (5, ""), (5, "")]
    names = ["lines", "_doc", "_gone", "doc", "flags", "run", "holder"]
    table = spark.createDataFrame([(*r, *names) for r in data], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = line_dedup.line_dedup(table).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted([(d or 0, t or "") for d, t in data if d != 4] + [(4, "four")])
    assert all([r[n] for n in names] == names for r in got)


def test_components_send_nothing_through_the_driver(spark, monkeypatch):
    """No table of links, nodes or fingerprints is broadcast, however small; several of them together filled a driver."""
    plans = []
    for name in ("written", "checkpointed"):
        inner = getattr(shared, name)

        def noted(df, *args, inner=inner):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return inner(df, *args)

        for module in (shared, simhash):
            monkeypatch.setattr(module, name, noted, raising=module is shared)
    docs = plain(spark, [(i, f"one two three four five six seven eight nine {i // 2}") for i in range(8)])
    for out in (simhash.near_dedup(docs), simhash.near_duplicates(docs)):
        assert out.count() == 8
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and not [x for x in plans if "Broadcast" in x]


def test_long_texts_that_are_unlike_are_not_compared_whole(spark, monkeypatch):
    """Their fixed marks are all set; the bitmaps that grow with them, of two sizes here, rule them out, and keep what is alike."""
    seen, inner = {}, simhash.written

    def noted(df, name, *args):
        seen.setdefault(name, []).append(out := inner(df, name, *args))
        return out

    monkeypatch.setattr(simhash, "written", noted)
    monkeypatch.setattr(simhash, "removed", lambda df: None)
    rng = random.Random(23)
    some = [f"w{rng.randint(0, 10**9)}" for _ in range(1500)]
    # 1,996 and 2,096 shingles, on both sides of a power of two; a quarter of both is the same.
    apart = [" ".join([*some[:500], *(f"w{rng.randint(0, 10**9)}" for _ in range(n))]) for n in (1500, 1600)]
    alike = " ".join([*some[500:], *some[:1000]])
    data = [(1, apart[0]), (2, apart[1]), (3, alike), (4, f"{alike} {' '.join(f'x{i}' for i in range(150))}")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(plain(spark, data)).collect()}
    assert got == dict(zip((1, 2, 3, 4), _near_groups(data))) == {1: 1, 2: 2, 3: 3, 4: 3}
    assert sum(x.count() for x in seen["shingles"]) == 2


def test_links_that_are_stars_take_one_round_and_none_take_none(spark, monkeypatch):
    """Rounds end at the first that changes nothing, also if that is the first."""
    inner, names = shared.written, []
    monkeypatch.setattr(shared, "written", lambda df, name, *a: names.append(name) or inner(df, name, *a))
    stars = spark.createDataFrame([(1, 2), (3, 1), (1, 4), (7, 8), (5, 5)], "a long, b long")
    assert rows(shared.connected_components(stars)) == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7)]
    assert len(names) == 5
    for none in (stars.where("a = b"), stars.where("a > 9"), stars.limit(0)):
        names.clear()
        assert shared.connected_components(none).count() == 0
        assert names == ["edges"]
    path = spark.range(40).selectExpr("id a", "id + 1 b")
    assert sorted(rows(shared.connected_components(path))) == [(i, 0) for i in range(41)]


def test_forest_reads_features_that_are_written(spark, monkeypatch):
    """The forest and its summary read their rows several times: files, not the long plan of the features."""
    words = secrets.dictionary(plain(spark, [(1, "river stone window garden " * 9)]))
    seen = []

    def fit(self, rows):
        seen.append(rows)
        raise StopIteration

    monkeypatch.setattr(secrets.RandomForestClassifier, "fit", fit)
    with pytest.raises(StopIteration):
        secrets.train(secrets.labelled_findings(spark, 100), words, secrets.transitions(words))
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and len(plan) < 5000 and seen[0].count() == 100
