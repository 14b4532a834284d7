"""The operators over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffspark.llm import bpe, chat, decontaminate, edit_counts, line_dedup, main_text, mixing, negatives, ngram_join, phrases, pii, quality, storage, tokenfile

VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality.quality(table(spark, sf_dir, "documents"))


def op7_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as token files and read back: place, count and checksum of each."""
    path = storage.shared_path(spark, "token-files")
    tokenfile.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY))
    return tokenfile.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicate documents for every document."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted along its reply path, with digests read back from the output."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], told.schema)
    made = chat.conversations(chat.chain(told.union(extra)))
    turns = chat.read_turns(F.col("formatted"))
    read = made.withColumn("turns", turns).withColumn("trained", chat.masked_text(F.col("formatted"), F.col("mask")))
    return read.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits: a language mark in front, seven characters of the middle
    cut, the character at three quarters replaced by the source."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    n = F.char_length(F.coalesce("text", F.lit("")))

    def edit(start, stop, text):
        return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), text.cast("string").alias("text"))

    half, late = F.floor(n / 2), F.floor(n * 3 / 4)
    edits = F.array(
        edit(F.lit(0), F.lit(0), F.concat(F.lit("["), F.coalesce("lang", F.lit("")), F.lit("] "))),
        edit(half, half + 7, F.lit("")),
        edit(late, late + 1, F.coalesce("source", F.lit(""))),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits"))
    counted = edit_counts.apply_edits(edit_counts.build(docs, ranks, pattern, keep=("edits",)), ranks, pattern)
    return counted.select("doc_id", "n_before", "n_tokens", "n_read", "n_edits")


def op6_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds at least half of a test item, with the item."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("item", "item_id")


def op10_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = main_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with words, the line that stands for it, and whether it is kept."""
    found = line_dedup.line_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "line_no", F.col("head_id").alias("head_doc_id"), "head_line", "kept")


def op4_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base hits, and spans of the terms that disclose them."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"),
        *map(count, pii.KINDS),
        F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"),
        pii.span_text(F.concat("base", "terms")).alias("spans"),
    )


def op11_phrase_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading phrases of two to five words of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources takes of every document; documents judged good are four times as likely drawn as those judged bad."""
    judged = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("judged"))
    weight = F.when(F.col("judged") == 1, 2.0).when(F.col("judged") == 0, 0.5).otherwise(1.0)
    mixed = mixing.mix(table(spark, sf_dir, "documents"), quality=judged.select("id", weight.alias("weight")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


QUERIES = {
    "op11_phrase_streams": op11_phrase_streams,
    "op12_weighted_mix": op12_weighted_mix,
    "op13_hard_negatives": op13_hard_negatives,
    "op4_disclosure": op4_disclosure,
    "op1_line_dedup": op1_line_dedup,
    "op10_crf_main_text": op10_crf_main_text,
    "op2_edit_counts": op2_edit_counts,
    "op6_benchmark_tiling": op6_benchmark_tiling,
    "op9_reply_trees": op9_reply_trees,
    "op3_token_file": op3_token_file,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op5_quality_rules": op5_quality_rules,
    "op7_rank_array_bpe": op7_rank_array_bpe,
}

ORACLES: dict[str, str] = {
    "op11_phrase_streams": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase
  FROM worded, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(w) >= size
),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size > 1),
cuts AS (
  SELECT c.lang, c.size, c.phrase, c.w, c.f AS a, k, l.f AS l, r.f AS r, n,
         CAST(1000::HUGEINT * c.f * n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 : c.size], ' ')
  JOIN totals t ON t.lang = c.lang
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT lang, inner_phrase, f FROM (
    SELECT lang, f, unnest([array_to_string(w[1 : size - 1], ' '), array_to_string(w[2 : size], ' ')]) AS inner_phrase FROM candidates
  )
),
left_over AS (SELECT * FROM lowest p WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = p.lang AND i.inner_phrase = p.phrase AND i.f >= p.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM left_over QUALIFY rank <= 2000""",
    "op12_weighted_mix": r"""
WITH judged AS (SELECT doc_id, max(quality) AS judged FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (
  SELECT d.doc_id, d.source,
         CAST(len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         -ln((CAST('0x' || substr(md5('42:' || CAST(coalesce(d.doc_id, 0) AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
           / CASE j.judged WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS k
  FROM documents d LEFT JOIN judged j ON d.doc_id = j.doc_id
),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS cap,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM docs GROUP BY source
),
placed AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(cap) OVER w, 0) AS caps_before, coalesce(sum(weight) OVER w, 0) AS weights_before
  FROM sources WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
judged_sources AS (SELECT *, (total - caps_before)::DOUBLE * weight > cap::DOUBLE * (weights - weights_before) AS capped FROM placed),
rest AS (
  SELECT sum(source_size) - coalesce(sum(cap) FILTER (capped), 0) AS words, sum(weight) FILTER (NOT capped) AS weights FROM judged_sources
),
targets AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE least(rest.words::DOUBLE * weight / rest.weights, cap::DOUBLE) END AS target
  FROM judged_sources, rest
),
drawn AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, least(floor(t.target / greatest(t.source_size, 1)), 3)::BIGINT AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN size > 0 AND whole < 3 AND 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn""",
    "op13_hard_negatives": r"""
WITH good AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.id AS anchor_id, r.id AS id, a.label = r.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM good a JOIN good r ON a.id != r.id WHERE a.id % 50 = 0
),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 3""",
    "op9_reply_trees": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
codes AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '#', ''))
            + length(text) - length(replace(text, '<', '')) AS text_chars,
         length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, '#', ''))
            + length(role) - length(replace(role, '<', '')) + length(role) - length(replace(role, chr(10), '')) AS role_chars
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + role_chars + 1 + text_chars + 8) AS BIGINT) AS formatted_chars
FROM codes GROUP BY conv_id""",
}
