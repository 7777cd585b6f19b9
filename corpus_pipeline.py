"""A training corpus from `documents`, in stages over Parquet.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of the documents they got.  `run` writes each stage's result
to the shared folder and reads it back as the next one's documents.

- language: documents in which no language can be told (null, or no letters) go.
- near_duplicates: of each group of near copies the document with the smallest
  id stays (null ids last, then the smallest text digest; repeated rows once).
- repeated_passages: bytes of passages of PASSAGE bytes that stand elsewhere too
  are cut from the texts.  A character goes only if all its bytes do; n_chars
  follows the text.
- decontamination: documents that hold a window of a benchmark item go.
- packing: pieces of token sequences with their place and their token ids
  (`ids`, little-endian 32-bit).

All stages run on the same executors, whose memory keeps what the largest batches
took.  So each stage limits the rows of a batch for the session (`limit_rows`).
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.llm import decontaminate, langid, packing, simhash, suffix_dedup
from clickloom.llm.common import as_bytes, limit_rows, stored, table
from clickloom.llm.queries import language_model, public_path

#: Bytes of a repeated passage: over 50 words have more in 99 of 100 places of the languages at hand.
PASSAGE = 200


def _plain(docs: DataFrame) -> DataFrame:
    """Columns by position, so that no name clashes with what an operator adds."""
    return docs.toDF(*(f"_in{i}" for i in range(len(docs.columns))))


def _at(docs: DataFrame, name: str) -> str:
    return f"_in{docs.columns.index(name)}"


def _named(result: DataFrame, docs: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """The input's columns back under their names and types, some of them changed."""
    changed = changed or {}
    return result.select(
        *(changed.get(c, F.col(f"_in{i}")).cast(docs.schema[c].dataType).alias(c) for i, c in enumerate(docs.columns))
    )


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    limit_rows(spark)
    plain = _plain(docs)
    found = langid.predict(plain, language_model(docs), _at(docs, "doc_id"), _at(docs, "text"), plain.columns)
    return _named(found.where("lang_pred <> 'und'"), docs)


def row_key(doc_id: Column, digest: Column) -> Column:
    """Id and text digest as one value; a null id differs from every other."""
    return F.concat(digest, F.when(doc_id.isNull(), "-").otherwise(F.concat(F.lit("+"), doc_id.cast("string"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    limit_rows(spark)
    plain, doc_id, text = _plain(docs), _at(docs, "doc_id"), _at(docs, "text")
    digest = F.sha2(F.coalesce(as_bytes(text), F.lit("").cast("binary")), 256)
    keyed = plain.select(doc_id, text, F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), digest.alias("d")).alias("_row"))
    marks = stored(simhash.fingerprints(keyed, 4, doc_id, text, ["_row"]), "marks")
    lowest = marks.groupBy("fp").agg(F.min("_row").alias("_low"))
    roots = lowest.join(simhash.linked(lowest.select("fp")), "fp")
    best = roots.groupBy("root").agg(F.min("_low").alias("_row"))
    chosen = best.select(row_key(F.col("_row.id"), F.col("_row.d")).alias("_key"))
    kept = plain.withColumn("_key", row_key(F.col(doc_id), digest)).join(chosen, "_key")
    others = [F.col(c).asc_nulls_last() for c in plain.columns if c not in (doc_id, text)]
    once = F.row_number().over(Window.partitionBy("_key").orderBy(*others, F.lit(0)))
    return _named(kept.withColumn("_nth", once).where("_nth = 1"), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    limit_rows(spark)
    text = _at(docs, "text")
    plain = _plain(docs).withColumn("_none", F.col(text).isNull())
    others = [c for c in plain.columns if c != text]
    cut = suffix_dedup.remove_repeats(plain, text, others, characters=True, length=PASSAGE)
    left = F.when(~F.col("_none"), F.col("kept").cast("string"))
    changed = {"text": left}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length(left)).otherwise(F.col(_at(docs, "n_chars")))
    return _named(cut, docs, changed)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    limit_rows(spark)
    plain = _plain(docs)
    leaks = decontaminate.find_leaks(
        plain, table(spark, sf_dir, "benchmark"), id_col=_at(docs, "doc_id"), text_col=_at(docs, "text"), keep=plain.columns
    )
    return _named(leaks.where("n_hit = 0"), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    limit_rows(spark)
    return packing.pack(docs, public_path("byte_bpe_50k.json"), keep_ids=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]

#: Fingerprints, suffix buckets and byte-pair merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
