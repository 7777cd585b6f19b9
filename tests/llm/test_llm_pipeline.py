
import corpus_pipeline
import pyarrow as pa
import pytest
from llm_cases import docs, odd_texts, plain_words, prose
from pyspark.sql import functions as F
from test_llm_duplicates import brute_fingerprint, brute_roots

from clickloom.llm import langid, packing, queries
from clickloom.llm.common import ARROW_ROWS, over_texts, stored

TABLES = "/root/testdata/sf0.001"


def brute_near(rows):
    roots = brute_roots({brute_fingerprint(t) for _, t in rows})
    best = {}
    for doc_id, text in rows:
        r = roots[brute_fingerprint(text)]
        key = (doc_id is None, doc_id or 0)
        best[r] = min(best.get(r, key), key)
    return sorted((n, i) for n, i in best.values())


def test_near_duplicates_keep_one_of_each_group(spark):
    texts = odd_texts() + [(0, prose(1, 120)), (70, None)]
    frame = docs(spark, texts)
    kept = corpus_pipeline.near_duplicates(spark, frame, TABLES)
    assert kept.columns == frame.columns and kept.dtypes == frame.dtypes
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert got == brute_near(texts)


def test_stages_on_odd_tables(spark):
    frame = docs(spark, odd_texts() + [(90, prose(2, 6000)[:3000] + " tail")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame.where("false"), TABLES).count() == 0
        got = stage(spark, frame, TABLES)
        assert got.columns == frame.columns, name
        rows = got.collect()
        if name == "repeated_passages":
            assert len(rows) == len(odd_texts()) + 1
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    assert corpus_pipeline.best_fit_packing(spark, frame.where("false"), TABLES).count() == 0


def test_kept_texts_go_to_python_once(spark):
    def run(slices):
        for batch in slices:
            shared = batch.column("text").buffers()[2].address == batch.column("_text").buffers()[2].address
            columns = [batch.column("doc_id"), batch.column("text"), pa.array([shared] * batch.num_rows)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "shared"])

    texts = [(i, t) for i, (_, t) in enumerate(odd_texts())]
    got = over_texts(docs(spark, texts), "text", ["doc_id", "text"], run, "doc_id long, text string, shared boolean").collect()
    assert all(r.shared for r in got)
    assert sorted((r.doc_id, r.text) for r in got) == texts


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_limit_the_rows_of_a_batch(spark, name, stage):
    """Also for what the caller runs: Spark reads the setting when a plan runs."""
    before = spark.conf.get(ARROW_ROWS)
    try:
        for rows, want in (("10000", "2000"), ("0", "2000"), ("500", "500")):
            spark.conf.set(ARROW_ROWS, rows)
            stage(spark, docs(spark, [(1, prose(1, 60))]), TABLES)
            assert spark.conf.get(ARROW_ROWS) == want
    finally:
        spark.conf.set(ARROW_ROWS, before)


def test_null_texts_stay_null_where_passages_go(spark):
    shared = prose(1, 120)
    texts = [(1, None), (2, ""), (3, shared + " x"), (4, "y " + shared), (5, "z"), (6, None)]
    rows = corpus_pipeline.repeated_passages(spark, docs(spark, texts), TABLES).collect()
    got = {r.doc_id: r.text for r in rows}
    assert len(rows) == 6 and (got[1], got[2], got[5], got[6]) == (None, "", "z", None)
    assert len(got[3]) < 10 and len(got[4]) < 10


def test_packing_returns_the_token_ids(spark):
    texts = [(i, prose(i, 900)) for i in range(4)] + [(8, None)]
    words = packing.WordIds(packing.load_bpe(queries.public_path("byte_bpe_50k.json")))
    rows = corpus_pipeline.best_fit_packing(spark, docs(spark, texts), TABLES).collect()
    for i, text in texts:
        own = sorted((r.piece, r.length, bytes(r.ids)) for r in rows if r.doc_id == i)
        assert b"".join(x for *_, x in own) == packing.text_ids(text or "", words) + b"\2\0\0\0"
        assert all(len(x) == 4 * n for _, n, x in own)


def test_run_equals_its_stages(spark):
    source = spark.read.parquet(f"{TABLES}/documents.parquet")
    steps, current = {}, source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stored(stage(spark, current, TABLES), name)
        steps[name] = {r.doc_id: r.text for r in current.collect()}
    told = langid.predict(source, queries.language_model(source)).where("lang_pred <> 'und'")
    assert steps["language"].keys() == {r.doc_id for r in told.collect()}
    near = brute_near(list(steps["language"].items()))
    assert sorted(steps["near_duplicates"]) == sorted(i for _, i in near)

    texts = {d: t.encode() for d, t in steps["near_duplicates"].items()}
    n = corpus_pipeline.PASSAGE
    seen = {}
    for t in texts.values():
        for i in range(len(t) - n + 1):
            seen[t[i : i + n]] = seen.get(t[i : i + n], 0) + 1
    for d, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        chars, at = [], 0
        for c in t.decode():
            size = len(c.encode())
            chars.append("" if all(gone[at : at + size]) else c)
            at += size
        assert steps["repeated_passages"][d] == "".join(chars)

    windows = set()
    for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect():
        w = plain_words(r.text)
        m = min(10, len(w))
        windows |= {tuple(w[i : i + m]) for i in range(len(w) - m + 1) if m}
    sizes = {len(w) for w in windows}
    clean = set()
    for d, t in steps["repeated_passages"].items():
        w = plain_words(t)
        if not any(tuple(w[i : i + m]) in windows for m in sizes for i in range(len(w) - m + 1)):
            clean.add(d)
    assert steps["decontamination"].keys() == clean and len(clean) > 100

    packed = corpus_pipeline.run(spark, TABLES)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == clean
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.sum("n"), F.count("*")).first()
    assert full[0] <= 1024 and full[2] <= full[1] / 1024 * 1.1 + 1
