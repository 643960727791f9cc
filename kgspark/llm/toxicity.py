"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

1. Lexicon.  Words of labelled rows, without case and with their disguise undone
   (``1d10t``, ``i.d.i.o.t``, ``idiooot``), count by class, whole and by their
   first 3 to 8 letters, which catches inflected and compounded forms in any
   language.  A form's weight is a cautious log odds ratio of its toxic share
   against the corpus's (``CAUTION`` standard errors off); forms above ``FLOOR``
   are kept, of these the ``MOST_FORMS`` with the greatest weights.
2. Features, dense numbers for each row: lexicon densities (share, weight, the
   greatest weight, distinct forms), their proximity to the second person,
   capitals, punctuation, and how often letters are disguised.
3. ``GBTClassifier`` on rows of folds 0 to 2, whose lexicon features leave the
   row's own fold out; ``IsotonicRegression`` of the label on the margin, over the
   rows of fold 3 that the trees have not seen.

The classifier is fitted on at most ``most`` labelled rows (``MOST_LABELLED``),
those with the smallest hashes of their id; the lexicon is part of it.  Scoring
takes every row and whole texts.  Labels, language, source and id are no inputs.

Defined results: a null text counts as empty; empty texts get the score of a text
without any sign; a repeated labelled id is toxic if any of its labels is; rows of
null label or id teach nothing; equal texts have equal scores; if the labels that
may be learned from are of one class, or none, every score is their toxic share
(0 without labels).  Columns of other names are left out.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.shared import written

#: Labelled rows that the classifier is fitted on, at most.
MOST_LABELLED = 200_000
#: Forms that the lexicon has, at most.
MOST_FORMS = 50_000
#: Lengths of the beginnings of words that are counted.
STEMS = range(3, 9)
#: Standard errors taken off a log odds ratio, and the least weight that a form has after that.
CAUTION, FLOOR = 2.0, 1.0
#: Labelled rows that have a form, at least.
MIN_ROWS = 3
#: Folds of labelled rows; the last calibrates.
FOLDS = 4
#: Words between a form of the lexicon and a second person that is near.
NEAR = 5
#: Fixed words: the second person in several languages.
SECOND_PERSON = frozenset(
    "you your yours yourself youre ur u tu te toi ton ta tes vous votre vos du dich dir dein deine deinen deiner ihr euch euer usted ustedes ti tus vosotros os vuestro".split()
)
#: Fixed letters: what stands for what in disguised words.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})

FEATURES = [
    "log_words", "hit_share", "log_hits", "log_distinct", "weight_mean", "weight_most", "weight_sum",
    "you_share", "near_share", "capital_share", "shouted_share", "exclaimed", "asked", "run_share", "symbol_share",
    "disguised_share", "spelled_share", "stretched_share", "hidden_hits",
]

_EDGE = " .,;:?\"'`()[]{}<>«»“”‘’…-_/\\*#%&=+~^"
#: A single letter, alone or with a mark after it: one of a spelled-out word if others are beside it.
_INNER = regex.compile(r"(?<=\p{L})[.\-_*'](?=\p{L}(?:[.\-_*']|$))")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_RUN = re.compile(r"[!?]{2,}")
_SYMBOL = re.compile(r"[#*$%&|<>@^~]")
_FORMS = 1 << 18


def plain(word: str) -> tuple[str, int, int]:
    """A word's letters without disguise, and whether it had any and was stretched."""
    low = word.lower().strip(_EDGE)
    end = low.rstrip("!")
    if end.isalpha():
        out, disguised = end, 0
    else:
        out = _INNER.sub("", end) if end.count(".") + end.count("-") + end.count("_") + end.count("*") + end.count("'") > 1 else end
        if any(c.isalpha() for c in out):
            out = out.translate(DISGUISE)
        out = "".join(c for c in out if c.isalpha())
        disguised = int(out != "".join(c for c in end if c.isalpha()) or len(out) > 2 and sum(map(str.isalpha, end)) == 1)
        disguised = int(disguised or end.count(".") + end.count("*") > 1 and len(out) > 2)
    stretched = 0
    if m := _STRETCH.search(out):
        out, stretched = _STRETCH.sub(r"\1", out), int(m is not None)
    return out, disguised, stretched


def forms(word: str) -> Iterator[str]:
    """What is counted of a word: itself with a mark, and its beginnings."""
    if word:
        yield word + "$"
        for n in STEMS:
            if len(word) >= n:
                yield word[:n]


def spelled(words: list[str]) -> list[str]:
    """Words, with runs of three or more single letters put together after them."""
    out, run = [], []
    for w in [*words, ""]:
        if len(w) == 1 and w.isalpha() or len(w) == 2 and w[0].isalpha() and w[1] in ".-_*":
            run.append(w[0])
            continue
        if len(run) >= 3:
            out.append("".join(run))
        run = []
    return out


class Known(dict):
    """Distinct words by number, and what ``describe`` says of each, once."""

    def __init__(self, describe, width: int):
        super().__init__()
        self.describe, self.waiting, self.rows = describe, [], np.zeros((0, width))

    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        self.waiting.append(word)
        return len(self) - 1

    def numbers(self, words: list[str]) -> np.ndarray:
        out = np.array(list(map(self.__getitem__, words)), np.int64)
        if self.waiting:
            new = np.array([self.describe(w) for w in self.waiting], float)
            self.rows = np.concatenate((self.rows, new)) if len(self.rows) else new
            self.waiting.clear()
        return out


class Reader:
    """Features of texts under one lexicon, a batch at a time; what is found for a word is kept for the next time it comes."""

    def __init__(self, lexicon: dict[str, tuple[float, ...]]):
        self.lexicon = lexicon
        self.heads = {f[:3] for f in lexicon}
        self.reset()

    def reset(self) -> None:
        self.known = Known(self.word, FOLDS + 11)

    def word(self, w: str) -> tuple:
        """Weights by fold left out and of all; whether disguised, stretched, second person, shouted, a single letter;
        capitals, exclamation and question marks, runs of both, symbols, characters."""
        form, disguised, stretched = plain(w)
        known = form[:3] in self.heads or len(form) < 3 and f"{form}$"[:3] in self.heads  # else it has no form of the lexicon
        weights = [self.lexicon[f] for f in forms(form) if f in self.lexicon] if known else ()
        weights = tuple(map(max, zip(*weights))) if weights else (0.0,) * (FOLDS + 1)
        letter = len(w) == 1 and w.isalpha() or len(w) == 2 and w[0].isalpha() and w[1] in ".-_*"
        marks = (0, 0, 0, 0) if w.isalpha() else (w.count("!"), w.count("?"), len(_RUN.findall(w)), len(_SYMBOL.findall(w)))
        capitals = 0 if w.islower() else sum(map(str.isupper, w))
        return (*weights, disguised and len(form) > 2, stretched, form in SECOND_PERSON, len(form) > 2 and w.isupper(), letter, capitals, *marks)

    def features(self, texts: list[str], folds: list[int]) -> np.ndarray:
        """``folds``: for each text the one whose labels the lexicon leaves out, or FOLDS for none."""
        if len(self.known) > _FORMS:
            self.reset()
        split = [t.split() for t in texts]
        size = np.array([len(w) for w in split])
        number = self.known.numbers([w for words in split for w in words])
        rows, doc = self.known.rows[number], np.repeat(np.arange(len(texts)), size)
        first = np.cumsum(size) - size
        # Words spelled out letter by letter, put together.
        spelled_doc, spelled_words = [], []
        for i in np.flatnonzero(np.bincount(doc, rows[:, FOLDS + 5], len(texts)) >= 3):
            whole = spelled(split[i])
            spelled_doc += [i] * len(whole)
            spelled_words += whole
        more = self.known.numbers(spelled_words)
        letters = np.bincount(np.array(spelled_doc, int), [len(w) for w in spelled_words], len(texts))
        known = self.known.rows
        per = lambda column: np.bincount(doc, rows[:, column], len(texts))
        n, chars = np.maximum(1, size), np.maximum(1, np.array([len(t) for t in texts]))
        # Hits of the lexicon.
        all_doc = np.concatenate((doc, np.array(spelled_doc, int)))
        all_number = np.concatenate((number, more))
        weight = known[all_number, np.array(folds)[all_doc]] if len(all_number) else np.zeros(0)
        hit = np.flatnonzero(weight > 0)
        hit_doc, hit_number, weight = all_doc[hit], all_number[hit], weight[hit]
        hits, total = np.bincount(hit_doc, minlength=len(texts)), np.bincount(hit_doc, weight, len(texts))
        most = np.zeros(len(texts))
        np.maximum.at(most, hit_doc, weight)
        distinct = np.bincount(np.unique(hit_doc * (len(self.known) + 1) + hit_number) // (len(self.known) + 1), minlength=len(texts))
        concealed = known[hit_number, FOLDS + 1] + known[hit_number, FOLDS + 2] > 0 if len(hit) else np.zeros(0, bool)
        hidden = np.bincount(hit_doc, concealed | (hit >= len(number)), len(texts))
        # Hits with a second person near, in the same text.
        persons, at = np.flatnonzero(rows[:, FOLDS + 3] > 0), hit[hit < len(number)]
        near = np.zeros(len(at), bool)
        if len(persons):
            right = np.searchsorted(persons, at)
            for other in (persons[np.maximum(right - 1, 0)], persons[np.minimum(right, len(persons) - 1)]):
                near |= (np.abs(other - at) <= NEAR) & (other >= first[doc[at]]) & (other < first[doc[at]] + size[doc[at]])
        near = np.bincount(doc[at], near, len(texts))
        one = np.maximum(1, hits)
        return np.column_stack((
            np.log1p(size), hits / n, np.log1p(hits), np.log1p(distinct), total / one, most, total / n,
            per(FOLDS + 3) / n, near / one, per(FOLDS + 6) / chars, per(FOLDS + 4) / n, per(FOLDS + 7) / n, per(FOLDS + 8) / n,
            per(FOLDS + 9) / n, per(FOLDS + 10) / chars, per(FOLDS + 1) / n, letters / n, per(FOLDS + 2) / n, hidden / n,
        ))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document teaches nothing: its id's CRC-32 is divisible by ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled(labels: DataFrame, held: Column, most: int = MOST_LABELLED, doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(doc_id, label, fold) of the labels to learn from, ``most`` at most."""
    rows = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held)
    rows = rows.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label).cast("double")).alias("label"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int"))


def lexicon(texts: DataFrame) -> dict[str, tuple[float, ...]]:
    """Forms with their weights: without each fold's labels, and with all.  ``texts``: text, label, fold."""

    def count(batches):
        """Counts by fold and class of the forms of a task's rows, of a form once a row."""
        names, words = {}, {}
        flat, first = array("i"), array("q", [0])  # numbers of each word's forms
        counts = np.zeros((0, 2 * FOLDS), np.int64)

        def rows():
            all_names = list(names)
            for lo in range(0, len(all_names), 1 << 14):
                part = counts[lo : min(lo + (1 << 14), len(all_names))]
                yield pa.RecordBatch.from_arrays([pa.array(all_names[lo : lo + (1 << 14)]), *(pa.array(np.ascontiguousarray(part[:, i])) for i in range(2 * FOLDS))], ["form", *columns])

        for batch in batches:
            for lo in range(0, len(batch), 256):
                texts, labels, folds = (c.slice(lo, 256).to_pylist() for c in batch.columns)
                doc, number = [], []
                for i, text in enumerate(texts):
                    split = (text or "").split()
                    for w in {*split, *spelled(split)}:
                        at = words.get(w)
                        if at is None:
                            at = words[w] = len(words)
                            flat.extend([names.setdefault(f, len(names)) for f in forms(plain(w)[0])])
                            first.append(len(flat))
                        number.append(at)
                    doc += [i] * (len(number) - len(doc))
                doc, number, starts = np.array(doc, np.int64), np.array(number, np.int64), np.array(first)
                size = starts[number + 1] - starts[number]
                form = np.array(flat)[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[number], size)].astype(np.int64)
                held = np.unique(np.repeat(doc, size) * (len(names) + 1) + form)
                kind = 2 * np.array(folds, np.int64) + (np.array(labels) > 0)
                if len(counts) < len(names):
                    counts = np.concatenate((counts, np.zeros((2 * len(names) - len(counts), 2 * FOLDS), np.int64)))
                np.add.at(counts, (held % (len(names) + 1), kind[held // (len(names) + 1)]), 1)
                if len(words) > _FORMS:
                    yield from rows()
                    names, words, flat, first, counts = {}, {}, array("i"), array("q", [0]), counts[:0]
        yield from rows()

    columns = [f"{c}{i}" for i in range(FOLDS) for c in ("clean", "toxic")]
    counted = texts.select("text", "label", "fold").mapInArrow(count, ", ".join(["form string", *(f"{c} long" for c in columns)]))
    counted = counted.groupBy("form").agg(*(F.sum(c).alias(c) for c in columns))
    size = {(r["fold"], r["label"] > 0): r["n"] for r in texts.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}  # FOLDS * 2 rows
    weights = []
    for left_out in range(FOLDS + 1):
        folds = [i for i in range(FOLDS) if i != left_out]
        toxic, clean = (sum((F.col(f"{c}{i}") for i in folds), F.lit(0)) for c in ("toxic", "clean"))
        all_toxic, all_clean = (sum(size.get((i, t), 0) for i in folds) for t in (True, False))
        a, b = toxic + 0.5, clean + 0.5
        c, d = F.lit(all_toxic + 1.0) - a, F.lit(all_clean + 1.0) - b
        ratio = F.log(a * d / (b * c)) - CAUTION * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        weights.append(F.when((toxic + clean >= MIN_ROWS) & (c > 0) & (d > 0) & (ratio >= FLOOR), ratio).otherwise(0.0).alias(f"w{left_out}"))
    scored = counted.select("form", *weights).where(f"w{FOLDS} > 0").orderBy(F.desc(f"w{FOLDS}"), "form").limit(MOST_FORMS)
    return {r["form"]: tuple(r)[1:] for r in scored.collect()}


def featured(rows: DataFrame, held, text: str = "text", fold: str | None = None) -> DataFrame:
    """``rows`` with FEATURES in place of the text; ``held``: the broadcast lexicon."""
    keep = [c for c in rows.columns if c != text]
    rows = rows.select(*keep, text)
    at, fold_at = len(keep), keep.index(fold) if fold else None

    def run(batches):
        reader = Reader(held.value)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                folds = part.column(fold_at).to_pylist() if fold else [FOLDS] * len(part)
                out = reader.features([t or "" for t in part.column(at).to_pylist()], folds)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(out[:, i]) for i in range(len(FEATURES)))], [*keep, *FEATURES])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} double" for c in FEATURES)]))


def fit(texts: DataFrame, held, trees: int = 20, depth: int = 4):
    """(trees, calibration) on ``texts`` (text, label, fold)."""
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    rows = written(featured(texts.select("label", "fold", "text"), held, fold="fold"), "toxicity-rows")
    # One order of rows, whatever the partitions were; MOST_LABELLED rows of numbers at most.
    rows = assembler.transform(rows.orderBy("fold", "label", *FEATURES).coalesce(1)).select("label", "fold", "features").cache()
    seen = rows.where(f"fold < {FOLDS - 1}")
    if seen.select("label").distinct().count() < 2:
        seen = rows
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=11, featuresCol="features", labelCol="label").fit(seen)
    rest = model.transform(rows.where(f"fold = {FOLDS - 1}")).select("label", _margin().alias("margin"))
    if rest.select("label").distinct().count() < 2:
        rest = model.transform(rows).select("label", _margin().alias("margin"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(rest)
    rows.unpersist()
    return model, calibration


def _margin() -> Column:
    return vector_to_array("rawPrediction")[1]


def score(docs: DataFrame, labels: DataFrame, held: Column | None = None, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    ``labels``: doc_id, toxic.  ``held``: a condition on doc_id for rows whose
    labels are not learned from.
    """
    held = held_out(F.col("doc_id")) if held is None else held
    docs = docs.select("doc_id", "text")
    known = written(labelled(labels.select("doc_id", "toxic"), held, most), "toxicity-labels")
    texts = written(docs.join(F.broadcast(known), "doc_id").select("text", "label", "fold"), "toxicity-texts")  # MOST_LABELLED rows of numbers
    classes = known.agg(F.count("*").alias("n"), F.avg("label").alias("share")).first()
    shown = texts.select("label").distinct().count()
    out = docs.withColumn("held_out", held)
    if shown < 2:
        share = float(classes["share"] or 0)
        return out.select("doc_id", "held_out", F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    forms_ = docs.sparkSession.sparkContext.broadcast(lexicon(texts))  # MOST_FORMS forms at most
    model, calibration = fit(texts, forms_)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(out, forms_))
    rows = calibration.transform(model.transform(rows).withColumn("margin", _margin()))
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    return rows.select("doc_id", "held_out", value.alias("score"), F.when(value >= 0.5, 1).otherwise(0).alias("predicted"))
