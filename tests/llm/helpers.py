"""Documents with everything that operators must take, and words as the contracts define them."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns with names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, ids string, block int, line string, k long, shard long, keep_id long, x0 long, word string, n_words string"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n):
    vocab = ["stone", "river", "Élan", "cloud", "paper", "window", "garden", "naïve", "seven", "light", "winter", "table", "forest", "music", "harbour", "letter", "日本", "market"]
    return " ".join(rng.choice(vocab) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def texts(seed=3):
    """(doc_id, text): null and empty texts, ties, copies, near copies, repeated rows, a long text, a null doc_id."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(12, 120)) for _ in range(12)]
    out = list(enumerate(base, 10))
    out += [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, " "), (7, "a\x00b c"), (8, "x" * 300)]
    out += [(40, base[0]), (41, base[0].replace(" ", "  \n")), (42, base[1] + " more"), (43, base[1].upper()), (44, base[2].replace("stone", "stones", 1))]
    out += [(50, " ".join([base[3], base[4], base[5]])), (51, base[5] + "\n" + base[3]), (52, "again " * 60), (53, "again " * 60)]
    out += [(60, prose(rng, 30000)), (10, base[0]), (11, base[6]), (-5, base[7]), (None, base[8]), (None, None), (70, "Ünï cödé 😀 text with   gaps\r\nand\x0bmore")]
    return out


def documents(spark, rows=None):
    full = [(d, t, ["en", "fr", None][i % 3], ["s1", "s2", None][i % 3 if i % 5 else 0], len(t) if t else None, 7, "ids", 1, "line", 9, 2, 5, 1, "w", "n") for i, (d, t) in enumerate(texts() if rows is None else rows)]
    return spark.createDataFrame(full, SCHEMA)


def plain(spark, rows):
    """Rows (doc_id, text[, source]) as a documents table."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s1", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
