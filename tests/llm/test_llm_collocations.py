import random
import re
from collections import Counter

from llm_cases import LOWER, docs, odd_texts, prose, rows_of

from clickloom.llm import collocations

OUT = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(texts, least, longest, best):
    n, f = Counter(), Counter()
    for text, lang in texts:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    cands = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    rows = []
    for (lang, p), a in cands.items():
        around = [
            q for (other, q), b in cands.items()
            if other == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q)))
        ]
        if around:
            continue
        cuts = []
        for k in range(1, len(p)):
            l, r = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((1000 * a * n[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        rows.append((lang, -score, -a, " ".join(p).encode(), l, r))
    out, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= best:
            out.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out, key=repr)


def cases():
    r = random.Random(5)
    texts = [(t, lang) for (_, t), lang in zip(odd_texts(), ["en", None, "de", "und", "en"] * 3)]
    words = "new york city is a big Apple of the state".split() + ["Über", "x y", "a-b", "日本", "\x00z"]
    for i in range(60):
        text = ""
        for _ in range(40):
            text += r.choice(["New York City", "new york", *words, "of the", "the the the"]) + r.choice([" ", " ", "\t", ". ", "!?", "\n", "  ", ","])
        texts.append((text, r.choice(["en", "de", None])))
    return [*texts, (None, "en"), ("", None), (prose(7, 30000), "en")]


def test_collocations_equal_brute_force(spark, monkeypatch):
    texts = cases()
    frame = docs(spark, [(i, t) for i, (t, _) in enumerate(texts)], [lang for _, lang in texts])
    for least, longest, best in ((8, 5, 40), (25, 3, 2000)):
        got = collocations.collocations(frame, least=least, longest=longest, best=best)
        assert tuple(got.columns) == OUT
        want = brute(texts, least, longest, best)
        assert rows_of(got, *OUT) == want and len(want) > 20
    assert collocations.collocations(frame.where("false")).count() == 0
    assert collocations.collocations(docs(spark, [(1, None), (2, "")])).count() == 0


def test_rare_pairs_are_not_spelt_out(spark, monkeypatch):
    """Pairs of frequent words that are rare themselves are counted by hash only."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(["new york", "x" * 3, *words]) for _ in range(60)) for _ in range(120)]
    texts += ["new york " * 300, "a b . b a . " * 9]
    frame = docs(spark, list(enumerate(texts)), [r.choice(["en", "de"]) for _ in texts])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spelt, before, counts = [], spark.conf.get(key), collocations.added_by_part

    def seen(relation, counted, least):
        found = relation.mapInArrow(lambda b: (c.select(["phrase"]) for c in counted(b)), "phrase string")
        spelt.append((found.count(), spark.conf.get(key)))
        return counts(relation, counted, least)

    monkeypatch.setattr(collocations, "added_by_part", seen)
    monkeypatch.setattr(collocations, "LOAD", 0.001)
    got = collocations.collocations(frame, least=30)
    langs = [row.lang for row in frame.select("doc_id", "lang").orderBy("doc_id").collect()]
    want = brute(list(zip(texts, langs)), 30, 5, 2000)
    assert rows_of(got, *OUT) == want and len(want) > 2
    pairs = {(lang, *p) for t, lang in zip(texts, langs) for piece in t.split(".") for p in zip(piece.split(), piece.split()[1:])}
    assert len(pairs) > 3000 and spelt[0][0] < 300
    assert {rows for _, rows in spelt} == {"2000"} and spark.conf.get(key) == before


def test_relation_slices_keep_documents_whole():
    import pyarrow as pa

    words = [["a", "b", "c"], [], ["a", "b"], ["c"] * 9]
    at = pa.array([list(range(len(w))) for w in words], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), at, pa.array(words)], names=["lang", "at", "word"])
    old, collocations.WORDS = collocations.WORDS, 4
    try:
        found = [list(o.words.to_pylist()) for o in collocations.slices_of([batch])]
    finally:
        collocations.WORDS = old
    assert found == [["a", "b", "c"], ["a", "b"], ["c"] * 9]


def test_relation_is_packed_and_phrases_write_no_files(spark, monkeypatch):
    """The relation's rows hold no lists, whose elements would pass the JVM one by one; tables of phrases are not written."""
    import pyarrow as pa

    monkeypatch.setattr(collocations, "WORDS", 5)
    words = [["a", "日本", "\x00z"], ["b"], ["a", "b", "a", "c"], ["d"] * 9, ["x"]]
    at = [[4, 5, 9], [0], [1, 2, 7, 1 << 30], [*range(0, 18, 2)], [1]]
    lists = (pa.array(at, pa.list_(pa.int32())), pa.array(words))
    langs = pa.array(["en", "de", "und", "en", "fr"])
    ends = lists[0].offsets.to_numpy()
    rows = collocations.packed(langs, ends, lists[0].flatten().to_numpy(), lists[1])
    got = [b for half in (rows.slice(0, 2), rows.slice(2), rows.slice(0, 0)) for b in collocations.unpacked([half])]
    for name, want in (("lang", langs.to_pylist()), ("at", at), ("word", words)):
        assert [x for b in got for x in b.column(name).to_pylist()] == want
    assert [b.num_rows for b in got] == [2, 1, 1, 1]

    written, stored = [], collocations.stored
    monkeypatch.setattr(collocations, "stored", lambda df, name, **o: written.append((name, df.schema)) or stored(df, name, **o))
    frame = docs(spark, list(enumerate(["a b c d e f. a b"] * 9)))
    found = {row.phrase: row.a for row in collocations.collocations(frame, least=8).collect()}
    assert found == {"a b": 18, "a b c d e": 9, "b c d e f": 9}
    assert [prefix for prefix, _ in written] == ["words"] + ["occurrences"] * 4
    assert all(f.dataType.typeName() in ("string", "binary") for _, schema in written[1:] for f in schema)
