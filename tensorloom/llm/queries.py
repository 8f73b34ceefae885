"""One query per corpus operator, and the SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.bpe import bpe_round_trip
from tensorloom.llm.common import documents, materialize
from tensorloom.llm.conversations import repair_conversations
from tensorloom.llm.embeddings import near_vectors
from tensorloom.llm.fingerprint import edited_fingerprints, resemblance, written
from tensorloom.llm.license_scan import license_scan
from tensorloom.llm.line_dedup import line_dedup
from tensorloom.llm.mixing import deal_key, mix, token_count
from tensorloom.llm.ngram_join import jaccard_components
from tensorloom.llm.pii import KINDS, find_pii, span_text, spans_of_kind
from tensorloom.llm.quality import quality_rules
from tensorloom.llm.sharding import shard_documents
from tensorloom.llm.spelling import slipped_words, spelling_variants
from tensorloom.llm.toxicity import toxicity


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_round_trip(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids_packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), n=4, percent=85)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of one tree per source; each eighth id is named as a license file.

    The table has no paths, so the query makes them: <source>/<id div 1024>/<id div 128>/<name>,
    and <source>/<id div 1024>/<name> for each sixty-fourth id.
    """
    name = F.concat(F.when(F.col("doc_id") % 8 == 0, F.lit("LICENSE-")).otherwise(F.lit("doc-")), F.col("doc_id"), F.lit(".txt"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.expr("doc_id div 1024"), F.when(F.col("doc_id") % 64 != 0, F.expr("doc_id div 128")), name)
    return license_scan(documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    counts = {f"n_{kind}": spans_of_kind(F.col("base"), k) for k, kind in enumerate(KINDS)}
    return out.withColumns(counts).select(
        "doc_id",
        *counts,
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        spans_of_kind(F.col("spans"), -1).alias("n_terms"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("sanitised", 256).alias("sanitised_sha256"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edited_fingerprints(documents(spark, sf_dir))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written(a).alias("fingerprint"),
        written(b).alias("edited_fingerprint"),
        resemblance(a, b).alias("near_edited"),
        resemblance(a, c).alias("near_next"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights nearly even, but no source repeated by more than a quarter pass; the largest source passes once, so no document is left out."""
    # The texts are read once, for their sizes.
    docs = materialize(documents(spark, sf_dir).select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"), deal_key().alias("key")), "sizes")
    out = mix(docs, budget=None, target_entropy=0.9999, max_repeats=1.25, tokens_col="n_tokens", key_col="key")
    return out.select("doc_id", "source", "n_tokens", "weight", "epoch", "mix_key")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = slipped_words(documents(spark, sf_dir).select("doc_id", "text"), min_chars=6)
    return spelling_variants(words, min_count=5, ratio=5).select("word", "form", "root", "n", "n_near", "form_n")


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), cosine=0.95)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_conversations(rows)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_ngram_join": op2_ngram_join,
    "op3_license_scan": op3_license_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_pii": op5_pii,
    "op6_line_dedup": op6_line_dedup,
    "op7_sharding": op7_sharding,
    "op8_fingerprints": op8_fingerprints,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}

LINES_SQL = """
lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {table})
),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
),
hot AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
),
judged AS (
  SELECT k.*, coalesce(h.key IS NOT NULL AND k.doc_id <> h.keeper, FALSE) AS dropped FROM keyed k LEFT JOIN hot h ON k.key = h.key
)"""

#: CRC-32 (reflected polynomial 3988292384) of a list of bytes, with the table of its 256 single bytes.
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
#: Letters and signs below U+0800 as UTF-8.
BYTES = "flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)] END))"
CRC = "xor(list_reduce([4294967295] || " + BYTES + ", lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"

SPELLING_SQL = f"""
WITH crc AS (SELECT {CRC_TABLE} AS crc_table),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents
),
each AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY 1, 2
),
hashed AS (SELECT run, n, {CRC.format(text="id || ':' || run")} AS h FROM each, crc),
counted AS (
  SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, CAST(h % length(run) AS INT)) || substring(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, sum(n) AS n
  FROM hashed GROUP BY 1
),
words AS (SELECT word, CAST(n AS BIGINT) AS n FROM counted WHERE n >= 5 AND length(word) >= 6),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM words),
parts AS (SELECT DISTINCT word, k, substring(word, 1, k - 1) AS l, substring(word, k + 1) AS r FROM places),
pairs AS (
  SELECT a.word, b.word AS near FROM parts a JOIN parts b ON a.k = b.k AND a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT a.word, b.word FROM parts a JOIN words b ON a.l || a.r = b.word
  UNION SELECT b.word, a.word FROM parts a JOIN words b ON a.l || a.r = b.word
),
ranked AS (
  SELECT p.word, p.near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS k
  FROM pairs p JOIN words w ON w.word = p.near
),
formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 5 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 5 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.k = 1
),
chain AS (
  WITH RECURSIVE c AS (SELECT word, word AS root FROM formed UNION ALL SELECT c.word, f.form FROM c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
  SELECT c.word, c.root FROM c JOIN formed f ON f.word = c.root WHERE f.form IS NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word
"""

#: Edits row by row: ``ways`` holds the best (cost, audit) per conversation, row and state; ``hops`` the insertions before a row.
REPAIR_SQL = f"""
WITH RECURSIVE crc AS (SELECT {CRC_TABLE} AS crc_table),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
kinds AS (SELECT given.*, {CRC.format(text="id")} % 20 AS kind FROM given, crc),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE kind WHEN 0 THEN []::INT[] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds
),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM hurt
),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, substring(role, 1, 1) AS initial,
         rtrim(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' ') AS bare,
         lag(substring(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prev
  FROM ordered
),
judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen
),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM judged GROUP BY conv_id
),
hops(s, t, cost, ins, lines) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (0, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 5, 'I', ['user:']), (1, 3, 10, 'II', ['user:', 'assistant:']),
         (2, 2, 0, '', []), (2, 3, 5, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 5, 'I', ['user:'])
),
steps AS (
  SELECT j.conv_id, j.pos, h.s, e.t, h.cost + e.cost + CASE WHEN j.fault = 'truncated' AND e.op <> 'D' THEN 5 ELSE 0 END AS cost, h.ins || e.op AS ops,
         h.lines || CASE e.op WHEN 'D' THEN [] WHEN 'K' THEN [j.role || ':' || j.text] ELSE [CASE e.t WHEN 3 THEN 'assistant:' ELSE 'user:' END || j.text] END AS lines
  FROM judged j CROSS JOIN hops h JOIN (
    VALUES (0, 0, 'D', 2, ''), (1, 1, 'D', 2, ''), (2, 2, 'D', 2, ''), (3, 3, 'D', 2, ''), (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'), (1, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a'), (3, 2, 'K', 0, 'u'),
           (0, 2, 'R', 1, ''), (1, 2, 'R', 1, ''), (2, 3, 'R', 1, ''), (3, 2, 'R', 1, '')
  ) e(s, t, op, cost, initial) ON e.s = h.t AND (e.op = 'D' OR j.fault NOT IN ('blank', 'duplicate')) AND (e.op <> 'K' OR e.initial = j.initial)
),
ways AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS s, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM sums
  UNION ALL
  SELECT w.conv_id, w.pos + 1, p.t, min({{'cost': w.best.cost + p.cost, 'audit': w.best.audit || p.ops, 'lines': w.best.lines || p.lines}})
  FROM ways w JOIN steps p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.pos = w.pos + 1 AND p.s = w.s
  GROUP BY w.conv_id, w.pos, p.t
),
ends AS (
  SELECT w.conv_id, min({{'cost': w.best.cost + h.cost, 'audit': w.best.audit || h.ins, 'lines': w.best.lines || h.lines}}) AS best
  FROM ways w JOIN sums n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.pos JOIN hops h ON h.s = w.s AND h.t IN (0, 3) GROUP BY w.conv_id
)
SELECT g.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal,
       CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM given) g LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM g.conv_id
"""

ORACLE = {
    "op6_line_dedup": "WITH "
    + LINES_SQL.format(table="documents")
    + """
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op11_spelling_variants": SPELLING_SQL,
    "op13_conversation_repair": REPAIR_SQL,
}
