"""The operators over the given tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.conversations import damaged, repaired_digests
from tickloom.llm.fingerprints import fingerprint_edits
from tickloom.llm.languages import document_evidence, identify_languages, page_evidence, train as train_languages, visible_text
from tickloom.llm.frames import shared_folder
from tickloom.llm.leaks import find_leaks
from tickloom.llm.lexical import rank_documents
from tickloom.llm.lines import dedup_lines
from tickloom.llm.mixing import mixed_documents
from tickloom.llm.nearcopies import near_copies
from tickloom.llm.quality import classify_quality
from tickloom.llm.repeats import remove_repeats
from tickloom.llm.tokenfiles import checksums, read_token_files, write_token_files
from tickloom.llm.tokens import count_tokens, load_pieces
from tickloom.llm.toxicity import rate_toxicity, train as train_toxicity

VOCABULARY = os.environ.get("TICKLOOM_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")

#: The byte-level tokenizer's file; where it is not given, that of the package of public vocabularies.
TOKENIZER = os.environ.get("TICKLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify_quality(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("row.doc_id", "posterior", "score", "keep")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(table(spark, sf_dir, "documents"))


def language_model(docs: DataFrame) -> dict:
    return train_languages(docs, docs["text"], F.lower(docs["lang"]), docs["doc_id"])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, document_evidence(docs), language_model(docs), carry=["doc_id"])
    return found.select("row.doc_id", "language", "posterior", "accepted")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages with the evidence of their markup and address; grams are those of `documents`."""
    pages = table(spark, sf_dir, "pages")
    evidence = page_evidence(pages["url"], pages["html"])
    model = language_model(table(spark, sf_dir, "documents"))
    found = identify_languages(pages, evidence, model, text=visible_text(pages["html"]), carry=["page_id"])
    return found.select("row.page_id", "language", "posterior", "accepted")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), load_pieces(VOCABULARY), carry=["doc_id"])
    return counted.select("row.doc_id", "n_pretokens", "n_tokens", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return rate_toxicity(docs, model, carry=["doc_id"]).select("row.doc_id", "severity", "grade", "toxic")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, TOKENIZER)
    return checksums(read_token_files(spark, path)).withColumnRenamed("key", "doc_id")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    found = repaired_digests(damaged(given))
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    nothing = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
    ids = given.select("conv_id").distinct()
    joined = ids.join(found, ids["conv_id"].eqNullSafe(found["conv"]), "left").drop("conv")
    return joined.withColumns({**zeros, **nothing})


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_quality,
        op2_near_dedup,
        op3_line_dedup,
        op4_decontamination,
        op5_mixing,
        op6_language_id,
        language_of_pages,
        op7_token_counts,
        op8_toxicity,
        op9_suffix_dedup,
        op10_fingerprints,
        op11_token_files,
        op12_conversation_repair,
        op13_ranked_search,
    )
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op4_decontamination": r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT item_id, w, least(len(w), 10) AS size FROM item WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM sized, unnest(range(1, len(w) - size + 2)) AS t(i)
), sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM doc, sizes, unnest(range(1, len(w) - size + 2)) AS t(i)
), hits AS (
  SELECT g.doc_id, g.i, g.size, w.item_id FROM grams g JOIN windows w ON g.size = w.size AND g.words = w.words
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, size)) AS t(k) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit,
       coalesce(f.n_items, 0)::BIGINT AS n_items, sha256(coalesce(f.items, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)
""",
    "op13_ranked_search": r"""
WITH doc AS (
  SELECT row_number() OVER () AS line, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT row_number() OVER () AS number, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark
), totals AS (
  SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM doc WHERE len(w) > 0
), wanted AS (
  SELECT number, term, count(*) AS times FROM (SELECT number, unnest(w) AS term FROM item) GROUP BY number, term
), held AS (
  SELECT line, term, count(*) AS tf FROM (SELECT line, unnest(w) AS term FROM doc)
  WHERE term IN (SELECT term FROM wanted) GROUP BY line, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), totals
), lengths AS (
  SELECT line, doc_id, 100 - 75 + (75 * len(w) * n_docs) // n_terms AS m FROM doc, totals WHERE len(w) > 0
), scored AS (
  SELECT number, line, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN held USING (term) JOIN lengths USING (line) GROUP BY number, line
), ranked AS (
  SELECT number, doc_id, score, row_number() OVER (PARTITION BY number ORDER BY score DESC, doc_id) AS place
  FROM scored JOIN lengths USING (line) WHERE score > 0
)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked JOIN item USING (number) WHERE place <= 10
""",
    "op5_mixing": """
WITH counted AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), rates AS (
  SELECT source, sqrt(n) / (SELECT sum(sqrt(n)) FROM counted) * (SELECT sum(n) FROM counted) / n AS rate FROM counted
), steps AS (
  SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM rates
), chances AS (
  SELECT source, k, exp(k * ln(rate) - rate
    - sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END) OVER (PARTITION BY source ORDER BY k)) AS p FROM steps
), summed AS (
  SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS at_most FROM chances
), numbered AS (
  SELECT *, ('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents
), times AS (
  SELECT d.doc_id, count(*) AS copies FROM numbered d JOIN summed s
  ON s.source IS NOT DISTINCT FROM d.source AND s.at_most <= d.u GROUP BY d.doc_id
)
SELECT d.*, i AS copy, md5('mix:' || d.doc_id || ':' || i) AS shuffle_key
FROM documents d JOIN times t USING (doc_id), unnest(range(1, copies + 1)) AS x(i)
""",
}
