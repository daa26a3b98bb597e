"""One registered query per corpus operator, over the whole table it is meant for, with its oracle SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import alignment, chat, decontam, exact, fingerprints, lines, mixing, ngram_join, periodic, pii, token_counts, toxicity, warc

#: Domains of the labelled rows and their shares of the mixed corpus's tokens.
TARGETS = {"good": 0.9, "low": 0.09, "toxic": 0.01}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the labels of quality and toxicity."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))


def held_out(doc_id) -> F.Column:
    """Rows whose label is never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def toxic_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("label"))


def op1_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: n_tokens, the posterior of every domain, its rate, and the optimality gap of all rates."""
    mixture = mixing.fit(read(spark, folder, "documents"), domains(read(spark, folder, "labels")), TARGETS, ("doc_id",))
    rows = mixing.member_rates(mixture)
    return rows.select("doc_id", "n_tokens", *[F.col("posterior")[i].alias(f"p_{name}") for i, name in enumerate(TARGETS)], "rate", F.lit(mixture.rates.gap).alias("gap"))


def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_classes(read(spark, folder, "documents"))


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and digest of the plain spans, all spans, and the number of added ones."""
    rows = pii.personal_spans(read(spark, folder, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    plain = F.filter("spans", lambda s: ~s["added"])
    kinds = F.transform(plain, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda k: k == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    added = (F.size("spans") - F.size(plain)).cast("long").alias("n_added")
    return rows.select("doc_id", *counts, F.sha2(joined(plain), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), added)


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records read back from the bundles."""
    return warc.round_trip(read(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.perspectives(read(spark, folder, "conversations"))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_report(read(spark, folder, "documents"))


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_report(read(spark, folder, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document and benchmark item that overlap."""
    return decontam.find_overlaps(read(spark, folder, "documents"), read(spark, folder, "benchmark")).drop("row_key")


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    rows = token_counts.token_counts(read(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.withColumn("over_limit", F.col("n_tokens") > 4096)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    scores = toxicity.score_documents(docs, toxicity.train(docs, toxic_labels(read(spark, folder, "labels"))))
    return scores.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_copies(read(spark, folder, "documents"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.run_report(read(spark, folder, "documents"), planted=True)


def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.alignment_report(read(spark, folder, "documents"), *paths)


QUERIES = {
    "op1_soft_mixing": op1_soft_mixing,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_pii": op3_pii,
    "op4_warc": op4_warc,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_line_dedup": op6_line_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op2_ngram_jaccard_join": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
), classes AS (
  SELECT node, min(other) AS c FROM reach GROUP BY node
), degrees AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(c.c, d.doc_id) AS BIGINT) AS component_id, CAST(coalesce(g.n, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN classes c ON c.node = d.doc_id LEFT JOIN degrees g ON g.a = d.doc_id
""",
    "op6_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), keyed AS (
  SELECT *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM lines
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE s.k IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE s.k IS NULL), '')) AS kept_sha256
FROM keyed l LEFT JOIN shared s ON s.k = l.k AND l.doc_id < s.keeper GROUP BY l.doc_id
""",
    "op11_exact_dedup": """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS c FROM documents
), r AS (
  SELECT doc_id, c, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY c) AS group_size
  FROM d WINDOW w AS (PARTITION BY c ORDER BY n DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(c) AS text_sha256 FROM r
""",
    "op4_warc": """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest,
    max(page_id) OVER (PARTITION BY b) AS largest FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN largest END AS refers_to
FROM d
""",
    "op5_chat_formatting": """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, regexp_replace(replace(coalesce(role, 'unknown'), '<|', '<' || chr(8203) || '|'), '[\r\n]+', ' ', 'g') AS role,
    replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|') AS text FROM conversations
), placed AS (
  SELECT *, CAST(floor(turn / 256) AS BIGINT) AS block,
    (row_number() OVER (PARTITION BY conv_id, floor(turn / 256) ORDER BY turn NULLS FIRST, role, text) - 1) // 256 AS part FROM turns
), messages AS (
  SELECT t.*, p.participant, t.role = p.participant AS own,
    '<|im_start|>' || CASE WHEN t.role = p.participant THEN 'assistant' WHEN t.role = 'system' THEN 'system' ELSE 'user name=' || t.role END || chr(10) AS head,
    t.text || '<|im_end|>' || chr(10) AS body
  FROM placed t JOIN (SELECT DISTINCT conv_id, role AS participant FROM turns WHERE role <> 'system') p ON p.conv_id IS NOT DISTINCT FROM t.conv_id
), spans AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, participant, block, part ORDER BY turn NULLS FIRST, role, text) AS e FROM messages
)
SELECT conv_id, participant, block, CAST(part AS BIGINT) AS part, count(*) AS n_turns,
  CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS BIGINT) AS n_masked,
  coalesce(string_agg(CAST(e - length(body) AS VARCHAR) || ':' || CAST(e AS VARCHAR), ',' ORDER BY e) FILTER (WHERE own), '') AS masks,
  string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text) AS text
FROM spans GROUP BY conv_id, participant, block, part
""",
}
