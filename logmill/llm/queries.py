"""Thin registered queries over the operators, each on whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.llm import cotraining, decontaminate, frames, lines, near_dup, packing, pitman_yor, rules, substrings, token_counts
from logmill.llm.storage import limit_batches, materialize
from logmill.llm.tokenize import tokenizer_path

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    limit_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_corpus(table(spark, sf_dir, "documents"))


def op2_decision_list_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = materialize(rules.with_stats(docs).select("doc_id", "_stats"), "rule-stats")
    learned = rules.fit(stats, table(spark, sf_dir, "labels"))
    s = F.col("_stats")
    failed = rules.base_failed(s)
    return stats.select("doc_id", *(s[n].alias(n) for n in rules.STATS), failed.alias("base_failed"), (~failed & learned.keeps(rules.features(s))).alias("kept"))


def rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the quality rules that SQL can express."""
    s = F.col("_stats")
    found = rules.with_stats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(s[n].alias(n) for n in rules.STATS), rules.base_failed(s).alias("base_failed"))


def op3_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = frames.write_shards(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))
    return frames.read_shards(spark, shards).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), 4096)
    return packing.pack(pieces, 4096)


def op5_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0)).cast("long").alias("longest_match"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))
    return counts.withColumn("over_limit", counts.n_tokens > 512)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op8_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_min_max_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dup.near_duplicates(table(spark, sf_dir, "documents"), threshold=85)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_line_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the hash of the text that is left (null text: null)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.remove_repeated_windows(docs, counts=("n_lines", "n_removed"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pitman_yor_scores": op1_pitman_yor_scores,
    "op2_decision_list_rules": op2_decision_list_rules,
    "rule_statistics": rule_statistics,
    "op3_token_frames": op3_token_frames,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_suffix_array_decontamination": op5_suffix_array_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_cotrained_quality": op8_cotrained_quality,
    "op9_min_max_near_dup": op9_min_max_near_dup,
    "op10_line_window_dedup": op10_line_window_dedup,
}

#: The patterns of words in the contracts.
_SPACE_WORD, _LETTER_WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

RULE_STATISTICS_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE_WORD}') AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
windows AS (SELECT r, i, array_to_string(w[i : i + 2], ' ') AS k FROM starts),
repeated AS (SELECT r, k FROM windows GROUP BY r, k HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT windows.r, unnest(range(i, i + 3)) AS p FROM windows JOIN repeated ON repeated.r = windows.r AND repeated.k = windows.k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
duplicates AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
found AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  coalesce(duplicates.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words FROM d LEFT JOIN covered USING (r) LEFT JOIN duplicates USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM found
"""

OP5_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '{_LETTER_WORD}') AS w FROM documents),
b AS (SELECT row_number() OVER () AS b, coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, '{_LETTER_WORD}') AS w FROM benchmark),
iw AS (SELECT b, item, least(13, len(w)) AS size, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS k FROM iw),
places AS (SELECT b, item, size, i, array_to_string(w[i : i + size - 1], ' ') AS k FROM iw),
sizes AS (SELECT DISTINCT size FROM windows),
dw AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT dw.r, dw.i, dw.size, item FROM dw JOIN windows x ON x.size = dw.size AND x.k = array_to_string(dw.w[dw.i : dw.i + dw.size - 1], ' ')),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r),
met AS (SELECT dw.r, dw.i, p.b, p.size, dw.i - p.i AS diagonal, dw.i - row_number() OVER (PARTITION BY dw.r, p.b, dw.i - p.i ORDER BY dw.i) AS island
  FROM dw JOIN places p ON p.size = dw.size AND p.k = array_to_string(dw.w[dw.i : dw.i + dw.size - 1], ' ')),
longest AS (SELECT r, max(n) AS n FROM (SELECT r, max(i) - min(i) + max(size) AS n FROM met GROUP BY r, b, diagonal, island) GROUP BY r)
SELECT doc_id, coalesce(l.n, 0)::BIGINT AS longest_match, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(f.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered c USING (r) LEFT JOIN found f USING (r) LEFT JOIN longest l USING (r)
"""

OP7_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '{_SPACE_WORD}') AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
windows AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS k FROM starts),
repeated AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM windows JOIN repeated USING (k)),
words AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.r, string_agg(w[words.p], ' ' ORDER BY words.p) AS t, count(*) AS n FROM words ANTI JOIN gone ON gone.r = words.r AND gone.p = words.p GROUP BY words.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

OP9_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '{_SPACE_WORD}') AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0),
sets AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS s FROM starts),
sizes AS (SELECT r, count(*) AS n FROM sets GROUP BY r),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
links AS (SELECT a, b FROM pairs p JOIN sizes x ON x.r = p.a JOIN sizes y ON y.r = p.b WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS r, a AS s FROM both_ways UNION SELECT reach.r, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.s),
names AS (SELECT reach.r, min(d.doc_id) AS name FROM reach JOIN d ON d.r = reach.s GROUP BY reach.r)
SELECT doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, coalesce(name, doc_id) AS component_id, doc_id IS NOT DISTINCT FROM coalesce(name, doc_id) AS kept
FROM d LEFT JOIN sizes USING (r) LEFT JOIN names USING (r)
"""

OP10_SQL = f"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS r, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT r, doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM d WHERE text IS NOT NULL),
full_lines AS (SELECT r, doc_id, p, l[p] AS x, row_number() OVER (PARTITION BY r ORDER BY p) AS k FROM lines WHERE regexp_matches(l[p], '[^\x20\x09-\x0D]')),
windows AS (SELECT a.doc_id, a.r, a.k, a.p AS p1, b.p AS p2, c.p AS p3, a.x || chr(10) || b.x || chr(10) || c.x AS w
  FROM full_lines a JOIN full_lines b ON b.r = a.r AND b.k = a.k + 1 JOIN full_lines c ON c.r = a.r AND c.k = a.k + 2),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, k) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest([p1, p2, p3]) AS p FROM later),
kept AS (SELECT lines.r, string_agg(l[lines.p], chr(10) ORDER BY lines.p) AS t FROM lines ANTI JOIN gone ON gone.r = lines.r AND gone.p = lines.p GROUP BY lines.r),
counts AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, CASE WHEN text IS NOT NULL THEN sha256(coalesce(t, '')) END AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN counts USING (r)
"""

#: The other operators have no SQL: learned models (1, 2, 8) and library tokenizers (3, 4, 6).
ORACLE_SQL: dict[str, str] = {
    "rule_statistics": RULE_STATISTICS_SQL,
    "op5_suffix_array_decontamination": OP5_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op9_min_max_near_dup": OP9_SQL,
    "op10_line_window_dedup": OP10_SQL,
}
