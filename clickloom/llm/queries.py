"""The registered queries of the text operators and, where SQL can express them, their checks."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import (
    collocations, crf, decontaminate, langid, licenses, mixing, packing, quality_rules, simhash, spelling, suffix_dedup,
    toxicity, warc,
)
from clickloom.llm.common import table
from clickloom.llm.sampling import crc_mod
from clickloom.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def public_path(name: str) -> str:
    """The place of a public tokenizer file on this machine; every node has it at the same path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES["op4_packing"] = op4_packing


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES["op2_decontamination"] = op2_decontamination
SQL["op2_decontamination"] = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)
), spot AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM doc CROSS JOIN (SELECT DISTINCT m FROM win) WHERE len(w) >= m)
), hit AS (
  SELECT doc_id, i, spot.m, item_id FROM spot JOIN win ON spot.m = win.m AND spot.s = win.s
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text().alias("fingerprint"), "component_id")


QUERIES["op7_simhash"] = op7_simhash


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), brief=suffix_dedup.BRIEF)
    return cut.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), "n_shared",
    )


QUERIES["op10_suffix_dedup"] = op10_suffix_dedup


def language_model(docs: DataFrame) -> langid.Model:
    """Learned from documents whose crc32(doc_id) mod 3 is not 1."""
    return langid.train(docs.where(crc_mod("doc_id", 3) != 1))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, language_model(docs))
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES["op3_language"] = op3_language


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    rows = warc.read_archives(spark, path, payloads=False)
    # The archives are this query's own: a gap would be lost data, so it stops the query.
    whole = F.when(F.col("kind") == "gap", F.raise_error(F.concat_ws(" ", F.lit("gap in"), "file", "offset"))).otherwise(True)
    return rows.where(whole.cast("boolean")).select(
        F.col("page").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("kind").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )


QUERIES["op1_warc"] = op1_warc
SQL["op1_warc"] = """
WITH d AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
    (CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality_rules.judge(docs, quality_rules.references(docs))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "word_distance",
    )


QUERIES["op6_rules"] = op6_rules


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("license_spans")


QUERIES["op8_licenses"] = op8_licenses


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0))
    return toxicity.score(docs, model).select(
        "doc_id",
        (crc_mod("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_matches",
    )


QUERIES["op9_toxicity"] = op9_toxicity


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = crf.train(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2))
    return crf.score(docs, model).select(
        "doc_id",
        (crc_mod("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


QUERIES["op5_quality"] = op5_quality


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES["op11_collocations"] = op11_collocations
SQL["op11_collocations"] = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece
), total AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), f AS (
  SELECT lang, k, p, count(*) AS a
  FROM (SELECT lang, k, w[i:i + k - 1] AS p
        FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
              FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k))
  GROUP BY ALL HAVING count(*) >= 100
), inside AS (
  SELECT DISTINCT lang, unnest([p[1:k - 1], p[2:k]]) AS p, a FROM f WHERE k > 2
), candidate AS (
  SELECT * FROM f WHERE k > 1 AND (lang, p, a) NOT IN (SELECT (lang, p, a) FROM inside)
), cut AS (
  SELECT lang, p, a, k, unnest(range(1, k)) AS c FROM candidate
), scored AS (
  SELECT cut.lang, cut.p, cut.a, c, x.a AS l, y.a AS r, n,
         CAST((CAST(1000 AS HUGEINT) * cut.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.p = cut.p[1:c] JOIN f y ON y.lang = cut.lang AND y.p = cut.p[c + 1:cut.k]
       JOIN total ON total.lang = cut.lang
), lowest AS (
  SELECT *, array_to_string(p, ' ') AS phrase FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES["op12_spelling"] = op12_spelling
# The checksum goes by a table of 256 remainders that SQL derives from the polynomial.
SQL["op12_spelling"] = r"""
WITH remainders AS (
  SELECT list(list_reduce(list_concat([CAST(i AS BIGINT)], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) s(i)
), run AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS r
  FROM documents
), own AS (
  SELECT doc_id, r, count(*) AS c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS x FROM run GROUP BY doc_id, r
), summed AS (
  SELECT r, c, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
      list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda h, b: xor(h >> 8, t[1 + (xor(h, b) & 255)]))) AS h
  FROM own, remainders
), word AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, CAST(sum(c) AS BIGINT) AS n
  FROM summed GROUP BY 1 HAVING length(word) >= 7 AND sum(c) >= 2
), less AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)
), near AS (
  SELECT a.word, b.word AS v, b.n AS v_n FROM less a JOIN less b ON a.i = b.i AND a.s = b.s AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN word b ON a.s = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN word b ON a.s = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(v, row(-v_n, v)) AS v, max(v_n) AS v_n FROM near GROUP BY word
), form AS (
  SELECT word, CASE WHEN v_n >= 10 * n THEN v END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN v_n >= 10 * n THEN v_n END AS form_n
  FROM word LEFT JOIN best USING (word)
), path AS (
  WITH RECURSIVE step AS (
    SELECT word, word AS root FROM form
    UNION ALL SELECT step.word, form.form FROM step JOIN form ON form.word = step.root WHERE form.form IS NOT NULL
  ) SELECT step.word, root FROM step JOIN form ON form.word = root WHERE form.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM form JOIN path USING (word)
"""


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES["op13_mixing"] = op13_mixing
SQL["op13_mixing"] = r"""
WITH doc AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM doc GROUP BY source
), line AS (
  SELECT *, CAST(sum(s) OVER () AS DOUBLE) AS total, sum(w) OVER () AS weights,
         coalesce(sum(s) OVER (ORDER BY s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s_before,
         coalesce(sum(w) OVER (ORDER BY s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before
  FROM src
), level AS (
  SELECT (1.5::DOUBLE * total - 2.0::DOUBLE * s_before) / (weights - w_before) AS v
  FROM line WHERE v <= 2.0::DOUBLE * s / w ORDER BY s / w, source LIMIT 1
), aim AS (
  SELECT source, s, least(w * v, s * 2.0::DOUBLE) AS target,
         CASE WHEN s > 0 THEN CAST(floor(least(w * v, s * 2.0::DOUBLE) / s) AS BIGINT) ELSE 0 END AS certain
  FROM src, level
), plan AS (
  SELECT doc_id, doc.source, size, s, target, certain, target - certain * s AS "left", (target - certain * s) / s AS p,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496 AS u
  FROM doc JOIN aim ON doc.source IS NOT DISTINCT FROM aim.source
), ranked AS (
  SELECT *, (u / (1 - u)) / (p / (1 - p)) AS r FROM plan WHERE "left" > 0 AND size > 0
), first AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY r, doc_id, size ROWS UNBOUNDED PRECEDING) AS reached FROM ranked
), gap AS (
  SELECT *, "left" - coalesce(sum(size) FILTER (reached <= "left") OVER (PARTITION BY source), 0) AS gap FROM first
), second AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY r, doc_id, size ROWS UNBOUNDED PRECEDING) AS again
  FROM gap WHERE reached > "left" AND size <= gap
)
SELECT doc_id, size, s AS source_size, target, certain * size AS taken FROM plan WHERE NOT ("left" > 0 AND size > 0)
UNION ALL SELECT doc_id, size, s, target, (certain + 1) * size FROM first WHERE reached <= "left"
UNION ALL SELECT doc_id, size, s, target, certain * size FROM gap WHERE reached > "left" AND size > gap
UNION ALL SELECT doc_id, size, s, target, (certain + CAST(again <= gap AS BIGINT)) * size FROM second
"""
