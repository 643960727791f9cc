"""Operators 11 to 13 against brute force, and on cases with a known answer."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kgspark.llm import alignment, hard_negatives, toxicity
from tests.llm.helpers import documents, plain, rows, texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned(data):
    """Each text encoded by the libraries as a whole, grouped a byte at a time; counts over all texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()

    def bytes_b(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    out, held = [], defaultdict(int)
    for doc_id, text in data:
        groups = []
        if text:
            a = first.encode(" " + text, add_special_tokens=False).ids
            b = second.encode(text)
            x = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in a]
            y = [bytes_b(i) for i in b]
            raw = (" " + text).encode()
            if b"".join(x) == raw == b"".join(y):
                left, right, i, j = 0, 0, 0, 0
                now = ([], [])
                while i < len(a) or j < len(b):
                    if left <= right and i < len(a):
                        left += len(x[i])
                        now[0].append(a[i])
                        i += 1
                    else:
                        right += len(y[j])
                        now[1].append(b[j])
                        j += 1
                    if left == right:
                        groups.append(now)
                        now = ([], [])
        for pair in {(p, q) for g in groups for p in g[0] for q in g[1]}:
            held[pair] += 1
        out.append((doc_id, groups))
    most = defaultdict(int)
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    result = []
    for doc_id, groups in out:
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        result.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(result, key=repr)


ODD = [(90, "a▁b"), (91, "<|endoftext|> <s> </s> <unk> <0x41>"), (92, "éé ﬁ ½ ‍👩‍👩‍👧 \U0001f1e9\U0001f1ea"), (93, "  two  spaces   and\t\ttabs\n\n\nlines"), (94, "x\x00y﻿z"), (95, "=" * 500 + " " * 300 + "…" * 40), (96, "don't we'll I'm ’s 'S 1234567 3.14"), (97, " "), (98, "日本語のテキスト 한국어 العربية ไทย")]


def test_alignment(spark, monkeypatch):
    data = texts() + ODD
    assert rows(alignment.align(documents(spark, data).repartition(3), A, B, digest=True)) == aligned(data)


def test_units_are_encoded_as_in_the_whole_text():
    """Units of long and odd texts one by one give the ids of the whole text."""
    both = alignment.tokenizers(open(A, "rb").read(), open(B, "rb").read())
    rng = random.Random(4)
    words = ["Haus", "river1", "naïve", "x", "日本", "don't", "end.", "", "=", "\n", "  ", "\ttab", "2024", "\u00a0", "\u3000y", "\x1f", "\x85", "'s", "\r\n", "-", "\u200b", "👩‍👧"]
    long = [" ".join(rng.choice(words) for _ in range(20000)) for _ in range(3)] + ["x" * 100_000] + ["".join(rng.choice([*words, " "]) for _ in range(60)) for _ in range(400)]
    assert both.cuts
    for text in long:
        units = alignment.units_of(both, text)
        assert "".join(units) == " " + text
        assert [i for u in both.a.encode_batch(units, add_special_tokens=False) for i in u.ids] == both.a.encode(" " + text, add_special_tokens=False).ids
        assert [i for u in both.b.encode([u[1:] for u in units]) for i in u] == both.b.encode(text)


def test_alignment_of_small_packs(spark, monkeypatch):
    """Documents that repeat over many packs, tokenizers that take texts whole, and few links at a time: the same counts."""
    data = [(i % 5, x) for i, x in enumerate([t for _, t in texts()[:12]] * 2)]
    whole = aligned(data)
    assert rows(alignment.align(plain(spark, data).repartition(7), A, B, digest=True)) == whole
    both = alignment.tokenizers(open(A, "rb").read(), open(B, "rb").read())
    monkeypatch.setattr(alignment, "LINKS", 50)
    for cuts in (True, False):
        pack = alignment.Pack(alignment.Units(alignment.Tokenizers(both.a, both.b, both.bytes_a, both.bytes_b, cuts)))
        for d, t in data:
            pack.add(d, t)
        got = [r for b in pack.batches(0, True) for r in b.to_pylist()]
        assert [(r["doc_id"], r["n_links"], r["groups"]) for r in got if r["no"] is not None] == [(d, *next((w[4], w[7]) for w in aligned([(d, t)]))) for d, t in data]
        held = Counter()
        for _, t in data:
            groups = alignment.Units(both)
            for u in alignment.units_of(both, t):
                groups[u]
            groups.encode()
            pairs = set()
            for x, y in groups.groups:
                pairs |= {(i, j) for i in x for j in y}
            held.update(pairs)
        assert {(r["a"], r["b"]): r["n"] for r in got if r["a"] is not None} == held


def test_alignment_text_and_empty(spark):
    found = alignment.align(plain(spark, [(1, "one two")]), A, B).first()
    assert found["groups"].count(";") + 1 == found["n_groups"] and "|" in found["groups"]
    assert alignment.align(plain(spark, [(1, "x")]).where("doc_id > 1"), A, B).count() == 0
    assert rows(alignment.align(plain(spark, [(1, None), (None, "")]), A, B)) == sorted([(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")], key=repr)


def negatives(data, anchors):
    out = []
    ok = [(i, d, lab, v) for i, (d, lab, v) in enumerate(data) if d is not None and lab is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    q = {i: [int(np.floor(256 * c)) for c in v] for i, _, _, v in ok}
    for i, d, lab, _ in ok:
        if d not in anchors:
            continue
        score = lambda j: sum(a * b for a, b in zip(q[i], q[j]))
        others = sorted(((-score(j), e, m) for j, e, m, _ in ok if j != i))
        for s, e, _ in [o for o in others if o[2] == lab][:5]:
            near = [o for o in others if o[2] != lab and 80 * -s <= 100 * -o[0] <= 100 * -s][:5]
            out += [(d, e, k, n[1], -s, -n[0]) for k, n in enumerate(near, 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<double>, row long, cell int, anchor string"


def vectors(spark, data):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in data], VECTORS)


def mined(spark, data, anchors):
    table = vectors(spark, data)
    return sorted(map(tuple, hard_negatives.mine(hard_negatives.prepared(table, F.col("vec_id").isin(*anchors))).collect()))


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_hard_negatives(spark, monkeypatch, spread):
    """Clusters and noise; a hot label, ties, repeats, short and null vectors; small blocks and parts, so that bounds and merging count."""
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "PART", (40, 40))
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    data = [(i, int(rng.integers(0, 3) if i % 3 else 0), (centres[i % 6] + spread * rng.normal(size=8)).tolist()) for i in range(220)]
    data += [(500, 1, [0.0] * 8), (501, 1, data[7][2]), (7, 1, data[7][2]), (7, data[7][1], data[7][2]), (10, data[10][1], data[10][2])]
    data += [(502, None, [1.0] * 8), (503, 2, None), (504, 2, [1.0] * 7 + [None]), (505, 2, [float("nan")] * 8), (506, 2, [float("inf")] * 8), (None, 2, [1.0] * 8), (507, 2, [1.0, 2.0]), (508, 0, [])]
    anchors = list(range(0, 220, 10)) + [7, 500, 507]
    want = negatives(data, anchors)
    assert len(want) > 100 and mined(spark, data, anchors) == want


def test_hard_negatives_edges(spark):
    assert mined(spark, [(1, 0, [1.0]), (2, 1, [1.0])], [1]) == []
    assert mined(spark, [(1, 0, [1.0]), (2, 0, [1.0]), (3, 1, [0.9]), (4, 1, [0.5])], [1]) == [(1, 2, 1, 3, 65536, 58880)]
    assert mined(spark, [(1, 0, [-1.0]), (2, 0, [1.0]), (3, 1, [0.9])], [1]) == []  # a negative score has an empty window
    assert mined(spark, [(2, 0, [1.0])], [1]) == []
    assert hard_negatives.mine(hard_negatives.prepared(vectors(spark, [(1, 0, [1.0])]).where("vec_id > 1"), F.lit(True))).count() == 0
    with pytest.raises(ValueError):
        mined(spark, [(1, 0, [1e9])], [1])


def test_order_of_large_scores():
    scores = np.array([[2.0**52, 5.0, 2.0**52, 5.0, -np.inf], [1.0, 1.0, 1.0, 1.0, 1.0]])
    r, c = hard_negatives._first(scores, 2)
    assert sorted(zip(r.tolist(), c.tolist())) == [(0, 0), (0, 2), (1, 0), (1, 1)]


def toxic_corpus(seed=2, n=900):
    rng = random.Random(seed)
    calm = ["stone", "river", "cloud", "paper", "window", "you", "garden", "seven", "light", "winter", "table", "forest", "music", "your", "letter"]
    rude = ["grubnik", "zarfling", "morvex"]
    data, labels = [], []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(rng.randint(20, 80))]
        bad = i % 6 == 0
        for _ in range(rng.randint(1, 5) if bad else 0):
            w = rng.choice(rude) + rng.choice(["", "en", "s", "isch"])
            w = rng.choice([w, w, w, w.upper() + "!!", w.replace("i", "1").replace("o", "0")])
            words.insert(rng.randrange(len(words)), w)
        data.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return data, labels


def test_toxicity_on_held_out_rows(spark):
    data, labels = toxic_corpus()
    extra = [(2000, None), (2001, ""), (2002, "you g r u b n i k of a z.a.r.f.l.i.n.g"), (2003, "stone river"), (None, "morvex"), (None, None), (7, data[7][1])]
    table = documents(spark, data + extra)
    known = spark.createDataFrame(labels + [(None, 1, 1), (8, 1, None), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(table.repartition(3), known).collect()
    assert len(got) == len(data) + len(extra)
    truth = {d: t for d, _, t in labels}
    import zlib

    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    right = Counter((r["predicted"], truth[r["doc_id"]]) for r in held)
    assert right[1, 1] >= 0.9 * (right[1, 1] + right[0, 1]) and right[1, 1] >= 0.9 * (right[1, 1] + right[1, 0])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r["score"] for r in got if r["doc_id"] and r["doc_id"] >= 2000}
    assert by[2000] == by[2001] < 0.5 and by[2003] < 0.5 <= by[2002]
    assert len({r["score"] for r in got if r["doc_id"] == 7}) == 1


def test_toxicity_without_two_classes(spark):
    table = plain(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert rows(toxicity.score(table, none).select("score", "predicted")) == [(0.0, 0), (0.0, 0)]
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert rows(toxicity.score(table, one, F.lit(False)).select("score", "predicted")) == [(1.0, 1), (1.0, 1)]
    assert toxicity.score(table.where("doc_id > 5"), one).count() == 0


@pytest.mark.parametrize("word, form", [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("IDIOOOOT!!", "idiot"), ("tr@sh,", "trash"), ("(plain)", "plain"), ("...", ""), ("2024", ""), ("don't", "dont")])
def test_disguised_words(word, form):
    assert toxicity.plain(word)[0] == form
