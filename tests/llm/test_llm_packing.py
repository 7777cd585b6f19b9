import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest
from llm_cases import docs, odd_texts, rows_of

from clickloom.llm import packing
from clickloom.llm.queries import public_path

tokenizers = pytest.importorskip("tokenizers")
PATH = public_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer(reference):
    words = packing.WordIds(packing.load_bpe(PATH))
    texts = [
        "", " ", "a", "a b", "a  b c d", " lead and trail ", "x\n\ny z w", "tab\tand \n new line", "it's we'll don't I'm",
        "élan Über 日本語 テキスト 🙂 🙂🙂 ok", "a   b  c d", "1 2 33 444.5 %$# <|endoftext|> end", "a\n b c\r\n d e \n",
        "the of and " * 40, "word," * 30 + " tail a b",
    ]
    for text in texts:
        assert np.frombuffer(packing.packed_ids(text, words), "<u4").tolist() == reference(text), text


def test_pieces_and_places(spark, reference):
    texts = odd_texts()
    got = packing.pack(docs(spark, texts), PATH, capacity=256, keep_ids=True)
    assert got.columns[0] == "doc_id"
    rows = got.collect()
    want = []
    for doc_id, text in texts:
        ids = np.array([*reference(text), 2], "<u4")
        cut = len(ids) % 256 or 256
        edges = [0, *range(cut, len(ids) + 1, 256)]
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            want.append((doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].tobytes()))
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(repr, (tuple(r[n] for n in names) + (bytes(r.ids),) for r in rows))) == sorted(map(repr, want))
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(docs(spark, []), PATH).count() == 0


def test_added_tokens_in_texts_keep_their_ids(spark):
    t = tokenizers.Tokenizer.from_file(PATH)
    end = "<|endoftext|>"
    texts = [end, end * 3, f"a b {end} c d", f" {end}\n\n{end}  x", f"a{end}b c{end}", f"a  {end} b", "<|endoftext| > <|endoftext", f"x <{end}> y"]
    got = packing.pack(docs(spark, list(enumerate(texts))), PATH, keep_ids=True).collect()
    assert {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist()[:-1] for r in got} == {
        i: t.encode(text, add_special_tokens=False).ids for i, text in enumerate(texts)
    }


def test_long_whitespace_runs(reference):
    words = packing.WordIds(packing.load_bpe(PATH))
    run = 2_000_000
    for text in (" " * run + "a", "a b\n" + "\n" * run + "c", "a" + " \n" * run, "x\t" * 3 + "\u3000" * run + " y z"):
        got = np.frombuffer(packing.text_ids(text, words), "<u4")
        assert np.array_equal(got, np.array(reference(text), "<u4"))


def test_runs_are_cut_where_the_pattern_cuts(reference, monkeypatch):
    rng = np.random.default_rng(4)
    signs = [*packing.SPACES, *"\x1c\x1f\u180e\u200b\ufeff", *"aé1.'日"]
    p = np.array([8] * len(packing.SPACES) + [1] * (len(signs) - len(packing.SPACES)))
    texts = ["".join(rng.choice(signs, rng.integers(1, 60), p=p / p.sum())) for _ in range(400)]
    texts += [c * n + tail for c in packing.SPACES for n in (1, 2, 3, 4, 7) for tail in ("", "a", ".", " a")]
    for safe in (1, 2, 3, 5):
        monkeypatch.setattr(packing, "SAFE_RUN", safe)
        words = packing.WordIds(packing.load_bpe(PATH))
        for text in texts:
            runs = [m.span() for m in packing.re.finditer(f"[{packing.SPACES}]+", text) if m.end() - m.start() >= safe]
            assert list(packing.long_runs(text)) == runs
            # A single blank before a letter belongs to it: only runs of two are cut.
            if safe > 1:
                assert np.frombuffer(packing.packed_ids(text, words), "<u4").tolist() == reference(text), repr(text)


def test_exact_combinations():
    rng = np.random.default_rng(3)
    for _ in range(200):
        have = rng.integers(0, 3, 13)
        have[0] = 0
        gap = int(rng.integers(1, 25))
        found = packing.exact_combination(have.copy(), gap)
        can = [c for k in (1, 2, 3) for c in combinations_with_replacement(range(1, 13), k)
               if sum(c) == gap and all(n <= have[x] for x, n in Counter(c).items())]
        assert bool(found) == bool(can)
        assert found is None or tuple(sorted(found)) in {tuple(sorted(c)) for c in can}


def test_plan_uses_every_piece_once_and_fills():
    rng = np.random.default_rng(5)
    for size in (1, 40, 5000):
        counts = Counter(rng.integers(1, 129, size).tolist())
        used = Counter()
        sequences = 0
        for lengths, times in packing.plan(dict(counts), 128):
            assert sum(lengths) <= 128 and times > 0
            sequences += times
            for x in lengths:
                used[x] += times
        assert used == counts
        if size == 5000:
            halves = sum(n for k, n in counts.items() if k > 64)  # no two of these share a sequence
            assert sequences <= 1.02 * max(halves, sum(k * n for k, n in counts.items()) / 128) + 1


def test_one_length_holds_a_third(spark):
    texts = [(i, "same text here") for i in range(60)] + [(100 + i, "w " * i) for i in range(60)]
    got = packing.pack(docs(spark, texts), PATH, capacity=64)
    ids = rows_of(got, "sequence_id", "offset")
    assert len(set(ids)) == len(ids) == got.count()


def test_token_ids_stay_out_of_python_when_pieces_are_dealt(spark, capsys):
    packed = packing.pack(docs(spark, odd_texts()), public_path("byte_bpe_50k.json"), keep_ids=True)
    packed.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
    assert "ids" in packed.columns and packed.columns[-2:] == ["sequence_id", "offset"]
