import random
import re
import zlib
from collections import Counter

import pytest
from llm_cases import LOWER, docs, odd_texts, rows_of

from clickloom.llm import spelling

OUT = ("word", "form", "root", "n", "n_near", "form_n")


def brute_words(texts):
    counts = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(texts):
    words = brute_words(texts)
    form, out = {}, []
    for w, n in words.items():
        close = sorted((-words[v], v) for v in words if near(w, v))
        form[w] = (close[0][1] if close and -close[0][0] >= 10 * n else None, len(close))
    for w, n in words.items():
        root = w
        while form[root][0]:
            root = form[root][0]
        out.append((w, form[w][0], root, n, form[w][1], words.get(form[w][0])))
    return sorted(out, key=repr)


def cases():
    r = random.Random(11)
    base = ["business", "Morning", "aaaaaaa", "aaaaaaaa", "abababab", "façades", "élèvesà", "ÉLÈVES×", "thousand", "zzzzzzzzz", "straßen", "ab", "mornings"]
    letters = "abeozéß×ÀZ"
    texts = odd_texts()
    for i in range(150):
        out = []
        for _ in range(60):
            w = r.choice(base[: 1 + r.randrange(len(base))])
            if r.random() < 0.25:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :]])
            out.append(w)
        texts.append((1000 + i, r.choice([" ", ". ", "_", "9"]).join(out)))
    # A chain of forms, each ten times as frequent as the last.
    texts += [(5000, "chainaaa " * 2), (5001, "chainaab " * 21), (5002, "chainabb " * 250), (5003, "chainbbb " * 2600)]
    return texts


def test_variants_equal_brute_force(spark):
    texts = cases()
    want = brute(texts)
    assert sum(1 for w in want if w[1]) > 50 and any(w[1] != w[2] and w[1] for w in want)
    for chunk in (spelling.CHUNK, 7):
        got = spelling.variants(docs(spark, texts), chunk=chunk)
        assert tuple(got.columns) == OUT
        assert rows_of(got, *OUT) == want
    assert spelling.variants(docs(spark, [])).count() == 0
    assert spelling.variants(docs(spark, [(1, None), (None, ""), (2, "short runs only")])).count() == 0


@pytest.mark.parametrize("few", [0, spelling.FEW, 40])
def test_scan_equals_pairwise_comparison(monkeypatch, few):
    monkeypatch.setattr(spelling, "FEW", few)
    r = random.Random(2)
    words = sorted({"abc" + "".join(r.choice("abé") for _ in range(r.randrange(4, 9))) for _ in range(300)})
    scan = spelling.Scan(words[::2])
    for w in words:
        assert sorted(scan.words[i] for i in scan.near(w)) == [u for u in words[::2] if near(u, w)]
