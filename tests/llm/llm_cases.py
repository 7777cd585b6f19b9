"""Small tables with the awkward cases, and brute-force versions of the operators."""

import random
import re

ROW = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, n_words int, t int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def prose(seed, n, words=None):
    r = random.Random(seed)
    words = words or ["the", "of", "erent", "tion", "and", "hable", "inor", "whou", "stint", "a", "élan", "Über"]
    return " ".join(r.choice(words) + str(r.randrange(40)) * r.randrange(2) for _ in range(n))


def docs(spark, texts, langs=None):
    """Documents from (id, text) pairs, with extra columns named like results."""
    rows = []
    for i, (doc_id, text) in enumerate(texts):
        lang = langs[i] if langs else "en"
        rows.append((doc_id, text, lang, None, None if text is None else len(text), 0.5, "x", 3, None))
    return spark.createDataFrame(rows, ROW).repartition(3)


def odd_texts():
    """Null and empty texts, a null id, repeated rows, copies, a very long text."""
    a, long = prose(1, 120), prose(2, 6000)
    return [
        (1, a), (2, None), (3, ""), (4, a), (None, prose(3, 50)), (5, "One"), (5, "One"), (6, " \n "), (7, long),
        (8, prose(4, 30) + " " + a + " " + prose(5, 30)), (9, "!!! 123 ??"), (10, "日本語 テキスト"), (None, None),
    ]


def plain_words(text):
    return WORDS.findall((text or "").translate(LOWER))


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
