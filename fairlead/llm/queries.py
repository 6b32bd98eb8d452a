"""One query for each operator, over its whole table with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm import bestfit, conversations, exacttopk, hardnegatives, hostrules, htmlcrf, kdshard, lattice, linewindows, simhash, suffixes, unigram, urlgbt
from fairlead.llm.vocabulary import read_vocabulary

#: Files of public tokenizers; a name or a path that every worker can open.
PACKING_TOKENIZER, PIECE_MODEL = "word_bpe_49k.json", "piece_bpe_32k.model"
#: Words of a piece that long lines are cut into for windows of lines.
LINE_WORDS = 14
#: The query's rules: verdict, host and path.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = hostrules.judge_documents(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcrf.extract_pages(table(spark, sf_dir, "pages"))


def op4_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(table(spark, sf_dir, "documents"), read_vocabulary(tokenizer_path(PIECE_MODEL)))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdshard.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exacttopk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(PACKING_TOKENIZER), capacity=4096, end_id=1)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlgbt.judge_urls(pages, urlgbt.page_labels(pages), URL_RULES)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode_documents(table(spark, sf_dir, "documents"), read_vocabulary(tokenizer_path(PIECE_MODEL)).with_log_shares())


def op10_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linewindows.drop_repeated_lines(docs, wrap=LINE_WORDS)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.repair_summary(rows, dropped=F.col("dropped"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.drop_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_simhash, op2_host_rules, op3_html_text, op4_lattice_score, op5_kd_shards, op6_exact_top_k, op7_best_fit, op8_url_filter, op9_pieces, op10_line_windows, op11_hard_negatives, op12_conversation_repair, op13_suffix_dedup, pipeline]
    return {f.__name__: f for f in ops}


OP2_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
toks AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
wins AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM toks WHERE len(w) >= 8),
texts AS (SELECT r, i, array_to_string(w[i:i+7], ' ') AS t FROM wins),
again AS (SELECT r, t FROM texts GROUP BY r, t HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT x.r, unnest(range(x.i, x.i + 8)) AS p FROM texts x JOIN again USING (r, t)) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
measured AS (
  SELECT d.r, d.doc_id, d.source, CAST(len(t.w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(t.w, '')) AS BIGINT) AS word_chars,
         CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM docs d JOIN toks t USING (r) LEFT JOIN dup USING (r) LEFT JOIN covered c ON c.r = d.r),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured),
hosts AS (SELECT source AS host, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed) AS DOUBLE) AS f FROM based GROUP BY source),
total AS (SELECT sum(n) AS n, sum(f) AS f, count(*) AS k, sum(f) / sum(n) AS m FROM hosts),
spread AS (SELECT sum(h.n * (h.f / h.n - t.m) * (h.f / h.n - t.m)) / any_value(t.n) - any_value(t.m * (1 - t.m) * t.k / t.n) AS v FROM hosts h, total t),
prior AS (SELECT t.m, CASE WHEN t.m * (1 - t.m) = 0 THEN 1.0 ELSE least(greatest(t.m * (1 - t.m) / greatest(s.v, 1e-9) - 1, 1.0), 1e4) END AS k FROM total t, spread s),
verdicts AS (SELECT h.host, (h.f + p.m * p.k) / (h.n + p.k) <= 0.5 AS ok FROM hosts h, prior p)
SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.base_failed, NOT b.base_failed AND v.ok AS kept
FROM based b JOIN verdicts v ON b.source IS NOT DISTINCT FROM v.host
"""

OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
          FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
neg AS (SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
          CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
        FROM pos p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
        WHERE 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    """The others go beyond SQL (xxHash and shingle bits, trained models, tokenizers, packing) and have brute-force tests."""
    return {"op2_host_rules": OP2_SQL, "op6_exact_top_k": OP6_SQL, "op11_hard_negatives": OP11_SQL}
