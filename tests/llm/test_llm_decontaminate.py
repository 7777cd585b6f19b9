import random

from llm_cases import docs, odd_texts, plain_words, prose, rows_of

from clickloom.llm import decontaminate


def brute(texts, items, window=10):
    out = []
    for doc_id, text in texts:
        words, hit, found = plain_words(text), set(), set()
        for item, passage in items:
            w = plain_words(passage)
            m = min(window, len(w))
            for k in range(len(w) - m + 1 if m else 0):
                for i in range(len(words) - m + 1):
                    if words[i : i + m] == w[k : k + m]:
                        hit.update(range(i, i + m))
                        found.add("" if item is None else str(item))
        out.append((doc_id, len(words), len(hit), sorted(found)))
    return sorted(out, key=repr)


def cases():
    passage = prose(11, 40)
    w = passage.split()
    items = [
        (1, passage), (2, " ".join(w[5:25])), (3, "tiny item"), (4, None), (5, ""), (None, " ".join(w[:12]) + " zz"), (3, "tiny item"),
        (6, "a a a a a a a a a a a"), (12, " ".join(w[20:30])),
    ]
    texts = odd_texts() + [
        (20, passage.upper()), (21, "x " + " ".join(w[3:14]) + " y " + " ".join(w[20:30])), (22, "TINY, item! tiny item"),
        (23, " ".join(w[:9])), (24, "a " * 35), (25, "a " * 10), (26, "a " * 9), (26, "a " * 9),
    ]
    return texts, items


def test_equals_brute_force(spark):
    texts, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 100):
        got = decontaminate.find_leaks(docs(spark, texts), bench, block_bytes=block)
        assert rows_of(got, "doc_id", "n_words", "n_hit", "item_ids") == brute(texts, items)


def test_random_words(spark):
    r = random.Random(1)
    items = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(1, 9)))) for i in range(30)]
    texts = [(i, " ".join(r.choice("abcd") for _ in range(r.randrange(60)))) for i in range(40)]
    windows = decontaminate.windows_of([(i, t.encode()) for i, t in items], 4)
    matcher = decontaminate.Matcher(windows)
    want = {d: (h, f) for d, _, h, f in brute(texts, items, 4)}
    for d, text in texts:
        runs, found = matcher.scan(text.encode().split())
        assert (sum(b - a for a, b in runs), sorted(found)) == want[d]


def test_empty_tables(spark):
    texts, _ = cases()
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.find_leaks(docs(spark, texts), none)
    assert {(r.n_hit, tuple(r.item_ids)) for r in got.collect()} == {(0, ())}
    assert decontaminate.find_leaks(docs(spark, []), none).count() == 0
