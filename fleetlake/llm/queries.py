"""The registered queries of this package's operators, with production parameters, and SQL that states them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, dac_tokens, jaccard_join, mixing, piece_counts, quality_rules, suffix_dedup, tiff_media, toxicity, warc_archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its size and source, the source's target and the words that the mix takes; null texts have size 0,
    null sources are one source."""
    plan = mixing.planned(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col(mixing.COPIES) * F.col("size")).cast("long").alias("taken"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the tokens of its whole text; null texts are empty and have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_counts.with_token_counts(docs, _tokenizer_file("piece_bpe_32k.model")).drop("text")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its size before, what went, and what is left: the digest of its bytes, and the text (U+FFFD for
    characters that a cut has broken)."""
    found = suffix_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed")
    left = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return found.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), left)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of tokens and the digests of ids and decoded text; null texts are empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trips(docs, _tokenizer_file("byte_bpe_50k.json")).drop("text")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its set's size and the smallest doc_id that links reach; texts without words link with nothing."""
    return jaccard_join.joined(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the counts, the base rule and the verdict of the line rules; null texts have no words and fail."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judged(docs, cleaned=None).drop("text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the score of a model fitted outside the held-out fifth; null texts are scored as empty ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    found = toxicity.scored(docs, model)
    return found.select("doc_id", (toxicity.fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op8_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document what reading its TIFF back gives: payload, digests and features; null texts are empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tiff_media.read_back(tiff_media.with_media(docs).drop("text"), ["doc_id", "n_bytes"])


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its place, length and checksum as read from the token files; null texts hold the end id only."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = dac_tokens.write(docs, _tokenizer_file("word_bpe_49k.json"), end_id=2)
    return dac_tokens.read_checksums(spark, files, docs.schema["doc_id"].dataType.simpleString()).withColumnRenamed("key", "doc_id")


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page its record as read from the archives; null pages have empty payloads, which all refer to one."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    key = pages.schema["page_id"].dataType
    found = warc_archive.read(spark, warc_archive.write(pages), bodies=False)
    return found.select(F.col("key").cast(key).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(key).alias("refers_to"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_token_counts": op2_token_counts,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality_rules": op6_quality_rules,
    "op7_toxicity": op7_toxicity,
    "op8_tiff_media": op8_tiff_media,
    "op9_token_files": op9_token_files,
    "op10_warc_archive": op10_warc_archive,
}

_OP1 = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
         coalesce(sum(source_size) OVER w, 0)::BIGINT AS held,
         (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::BIGINT AS open
  FROM s
  WINDOW w AS (ORDER BY 2.0 * source_size / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  -- the level at which the sources below it are full and all others are not
  SELECT (3 * total - 4 * held) AS up, 2 * open AS down FROM r
  WHERE (3 * total - 4 * held) * weight < 4 * source_size::HUGEINT * open
  ORDER BY 2.0 * source_size / weight, source IS NULL, encode(source) LIMIT 1
), t AS (
  SELECT source, source_size,
         least(coalesce((weight * (SELECT up FROM level))::DOUBLE / (SELECT down FROM level), 2.0 * source_size), 2.0 * source_size)::DOUBLE AS target
  FROM s
), j AS (
  SELECT d.doc_id, d.size::BIGINT AS size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       ((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM j
"""

_OP5 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared.n >= 90 * (p.n + q.n - shared.n)
), either AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
  SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM reached r JOIN either e ON r.y = e.x
)
SELECT w.doc_id, coalesce(any_value(sizes.n), 0)::BIGINT AS n_shingles, min(reached.y) AS component_id
FROM w LEFT JOIN sizes USING (doc_id) JOIN reached ON reached.x = w.doc_id GROUP BY w.doc_id
"""

_OP10 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits FROM pages
), d AS (
  SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY body) AS first,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (list_reduce(list_transform(string_split(substr(bits, (5 * i + 1)::BIGINT, 5), ''), lambda b: b::INT), lambda x, y: 2 * x + y) + 1)::BIGINT, 1)), '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

SQL: dict[str, str] = {"op1_source_mix": _OP1, "op5_jaccard_join": _OP5, "op10_warc_archive": _OP10}
