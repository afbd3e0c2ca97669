"""Small tables for the training-data operators, with what real tables hold at their edges."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, key long, label string, _cuts string, train string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


def prose(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = ["w%d" % rng.randrange(5000) if k else "the" for k in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def hard_docs(spark, extra=()):
    """Nulls in every column, empty, blank and very long texts, repeated rows, columns named like internal ones."""
    long_text = prose(1, 60_000)
    rows = [
        (1, "A short Text.", "en", "s", 13), (2, None, None, None, None), (3, "", "", "", 0), (4, " \t\n ", "en", "s", 4), (None, "no id here", "en", "s", 10),
        (5, long_text, "en", "s", len(long_text)), (6, "same row", "en", "s", 8), (6, "same row", "en", "s", 8), (7, "Grüße, 漢字 ﬁn\u0000al", "de", "s", 17), (None, None, None, None, None),
        *extra,
    ]
    return spark.createDataFrame([(*r, "x", 1, "y", "z", "t") for r in rows], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
