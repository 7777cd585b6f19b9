import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from llm_cases import LOWER, docs, odd_texts, prose, rows_of

from clickloom.llm import graph, simhash, suffix_dedup


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_roots(values):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in root:
        for b in root:
            if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in root}


def test_fingerprint_and_components(spark):
    base = prose(30, 300)
    near = [" ".join(w if random.Random(k * 997 + i).random() > 0.01 else "changed" for i, w in enumerate(base.split())) for k in range(12)]
    texts = odd_texts() + [(40 + k, t) for k, t in enumerate(near)] + [(60, base), (61, base.upper())]
    want_fp = {t: brute_fingerprint(t) for _, t in texts}
    roots = brute_roots(set(want_fp.values()))
    low = {}
    for doc_id, text in texts:
        r = roots[want_fp[text]]
        if doc_id is not None:
            low[r] = min(doc_id, low.get(r, doc_id))
    want = sorted(((d, f"{want_fp[t]:016x}", low.get(roots[want_fp[t]])) for d, t in texts), key=repr)
    got = simhash.near_duplicates(docs(spark, texts)).select("doc_id", simhash.fingerprint_text().alias("f"), "component_id")
    assert rows_of(got, "doc_id", "f", "component_id") == want
    assert len({c for *_, c in want}) < len(texts) - 8
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_keys_meet_within_four_bits():
    rng = np.random.default_rng(0)
    golay = simhash.Golay()
    assert (golay.error > 0).sum() == 2**11 - 1
    a = rng.integers(-(2**63), 2**63, 3000, dtype=np.int64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, i % 5, replace=False):
            b[i] ^= np.uint64(1 << int(bit)).astype(np.int64)
    (ra, ka), (rb, kb) = simhash.fuzzy_keys(a, golay, True, True), simhash.fuzzy_keys(b, golay, True, True)
    left, right = set(zip(ra.tolist(), ka.tolist())), set(zip(rb.tolist(), kb.tolist()))
    assert {r for r, _ in left & right} == set(range(len(a)))
    assert len(left) == len(ka) < 130 * len(a)


def test_dense_and_chained_fingerprints(spark):
    r = random.Random(4)
    values = []
    for _ in range(3):
        centre = r.getrandbits(64)
        for _ in range(60):  # a dense ball
            v = centre
            for bit in r.sample(range(64), r.randrange(4)):
                v ^= 1 << bit
            values.append(v)
        for _ in range(25):  # a chain that leaves it four bits at a time
            for bit in r.sample(range(64), 4):
                centre ^= 1 << bit
            values.append(centre)
    values += [r.getrandbits(64) for _ in range(100)]
    signed = [v - (1 << 64) if v >> 63 else v for v in set(values)]
    got = {row.fp: row.root for row in simhash.linked(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    want = brute_roots(signed)
    groups, wanted = Counter(), Counter()
    for v in signed:
        groups[got[v]] += 1
        wanted[want[v]] += 1
    assert len(got) == len(signed) and groups.keys() == wanted.keys() and groups == wanted


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (3, 4)]
    got = dict(rows_of(graph.components(spark.createDataFrame(links, "a long, b long")), "node", "root"))
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(50)}


def test_few_links_take_no_rounds(spark, monkeypatch):
    """Links that fit a task are written once; more of them go through rounds to the same components."""
    writes, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, prefix: writes.append(prefix) or stored(df, prefix))
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(-i, -i - 1) for i in range(1, 60)]
    want = {}
    for a, b in links * 60:
        low = min(want.get(a, a), want.get(b, b))
        want[a] = want[b] = low
    apart = {a for a, b in links if a == b} - {v for a, b in links if a != b for v in (a, b)}
    frame = spark.createDataFrame(links, "a long, b long").repartition(5)
    assert dict(rows_of(graph.components(frame), "node", "root")) == {v: r for v, r in want.items() if v not in apart}
    assert writes == ["links"]
    assert rows_of(graph.components(frame, 7), "node", "root") == rows_of(graph.components(frame), "node", "root")
    assert len(writes) > 3


def brute_repeats(texts, length):
    data = [(d, (t or "").encode()) for d, t in texts]
    count = Counter(t[i : i + length] for _, t in data for i in range(len(t) - length + 1))
    out = []
    for d, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeat_cases():
    r = random.Random(9)
    shared, other = prose(70, 150), prose(71, 90)
    texts = odd_texts()
    for k in range(12):
        own = [prose(100 + k, r.randrange(60)), shared[r.randrange(200) :], prose(200 + k, 20), other[: 380 + k * 4], prose(300 + k, 9)]
        texts.append((50 + k, " ".join(own)))
    texts += [(80, "ab" * 600), (81, "a" * 399), (82, "a" * 400), (83, "a" * 401), (84, "xyz " * 300), (85, shared + shared)]
    near = shared.split()
    near[40] = "edit"
    texts += [(90, " ".join(near)), (91, " ".join(near)), (92, "é" * 250 + shared), (93, "ü" * 250 + shared)]
    return texts


@pytest.mark.parametrize("length", [400, 200])
def test_repeats_equal_brute_force(spark, length):
    texts = repeat_cases()
    want = brute_repeats(texts, length)
    got = suffix_dedup.remove_repeats(docs(spark, texts), length=length).collect()
    rows = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got]
    assert sorted(rows, key=repr) == want
    assert {r.n_shared for r in got} == {None}
    assert suffix_dedup.remove_repeats(docs(spark, []), length=length).count() == 0


def test_texts_are_compared_by_their_bytes(spark):
    """Two heads with one value under the mixing function, and 384 bytes that both texts share."""
    r = random.Random(0)
    tail = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(384))
    heads = ["xq bjygftecztwld", "vimxfckn*0{O7)?^"]
    assert len({suffix_dedup.mix(*np.frombuffer(h.encode(), "<u8").reshape(2, 1))[0] for h in heads}) == 1
    got = suffix_dedup.remove_repeats(docs(spark, [(i, h + tail) for i, h in enumerate(heads)]), brief=100).collect()
    assert [r.n_removed for r in got] == [0, 0] and all(r.n_shared > 0 for r in got)


def test_places_of_shorter_passages(spark):
    """Leaders whose next bytes stand elsewhere, in distinct texts counted by brute force."""
    texts = repeat_cases() + [(120 + k, prose(500 + k, 90) + prose(77, 45) + prose(600 + k, 60 + k)) for k in range(6)]
    texts += [(130, prose(900, 300)), (131, prose(901, 300))]
    data = [(t or "").encode() for _, t in texts]
    long = [t for t in data if len(t) >= 400]
    r = suffix_dedup.ranges(long, 400)
    leads = [{int(a) for a in r["lead"][r["text"] == i]} for i in range(len(long))]
    at = Counter(t[a : a + 100] for t, own in zip(long, leads) for a in own)
    want = {t: sum(at[t[a : a + 100]] > 1 for a in own) for t, own in zip(long, leads)}
    got = suffix_dedup.remove_repeats(docs(spark, texts), brief=100).collect()
    assert sorted((repr(r.doc_id), r.n_shared) for r in got) == sorted((repr(d), want.get(t, 0)) for (d, _), t in zip(texts, data))
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[120 + k].n_removed == 0 and by_id[120 + k].n_shared > 0 for k in range(6))
    assert by_id[130].n_shared == by_id[131].n_shared == 0


def test_pointers_tell_equal_strings():
    r = random.Random(3)
    text = "".join(r.choice("ab") for _ in range(300)).encode() * 3 + b"ab" * 200 + bytes(8)
    data = np.frombuffer(text, np.uint8)
    for depth in (8, 16, 64, 128):
        found = suffix_dedup.pointers(data, depth)[: len(text) - 8 - depth + 1]
        strings = [text[i : i + depth] for i in range(len(found))]
        kinds = dict(zip(strings, found.tolist()))
        assert [kinds[s] for s in strings] == found.tolist() and len(set(kinds.values())) == len(kinds)


@pytest.mark.parametrize("block", [1 << 20, 700, 1])
def test_ranges_in_blocks(block):
    """Whatever the blocks, ranges tile the windows, and equal ones of a block are found."""
    texts = [(t or "").encode() for _, t in repeat_cases()]
    texts = [t for t in texts if len(t) >= 400]
    r = suffix_dedup.ranges(texts, 400, max(block, 700))
    tiles = list(zip(*(r[k].tolist() for k in ("text", "first", "last"))))
    assert [(i, w) for i, a, b in tiles for w in range(a, b + 1)] == [(i, w) for i, t in enumerate(texts) for w in range(len(t) - 399)]
    strings = [texts[i][a : b + 400] for i, a, b in tiles]
    same = suffix_dedup.equal_ranges(texts, r, 400, block)
    assert all(strings[i] == strings[k] for i, k in enumerate(same))
    if block == 1 << 20:
        assert len(set(same.tolist())) == len(set(strings)) < len(strings)


def test_whole_characters():
    text = "aé日b".encode()
    assert suffix_dedup.whole_characters(text, 0, 2) == (0, 1)
    assert suffix_dedup.whole_characters(text, 2, 5) == (3, 3)
    assert suffix_dedup.whole_characters(text, 2, 6) == (3, 6)
    assert suffix_dedup.whole_characters(text, 0, len(text)) == (0, len(text))
