"""The queries of this subpackage for __spark_entry__.py, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontamination, importance, lattice_lm, near_dup, packing, prefix_trie, progressive_jpeg, quality_rules, substring_dedup, warc, whitening
from .common import table


def tokenizer(name: str) -> str:
    """The place of a vocabulary file: in the folder CROSSGRID_TOKENIZERS where that is set, else where the package of public tokenizers says."""
    folder = os.environ.get("CROSSGRID_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def __getattr__(name: str) -> str:
    """WORD_BPE and PIECES: files of two vocabularies, looked for when they are asked for, so that the other queries need none."""
    files = {"WORD_BPE": "word_bpe_49k.json", "PIECES": "piece_bpe_32k.model"}
    if name not in files:
        raise AttributeError(name)
    return tokenizer(files[name])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_n_runs").alias("n_runs"), F.col("_first_ids").alias("first_ids"), "text")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lm_scores(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), scanned=True)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_report(rows.unionByName(chat.sample_conversation(spark)))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.index_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive_jpeg.media_report(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_report(table(spark, sf_dir, "conversations"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_bpe, op3_substring_dedup, op4_lm_scoring, op5_near_dup, op6_quality_classifier, op7_chat_formatting, op8_packing, op9_warc, op10_progressive_jpeg, op11_prefix_trie, op12_decontamination, op13_embedding_whitening)}
_ESCAPED = r"'[<\[]\\*(/?s>|/?INST\]|\|(image|audio|document)\|>)'"
_BYTE5 = "CAST('0x' || substr(hex, CAST(1 + 10 * (i // 8) AS INTEGER), 10) AS BIGINT)"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: What SQL can express. The others' rows are compared with brute-force versions in tests/llm.
ORACLES: dict[str, str] = {
    "op7_chat_formatting": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.BOT + chat.EOR + chat.EOT)} + length(role) + len(regexp_extract_all(role, {_ESCAPED})) + length(text) + len(regexp_extract_all(text, {_ESCAPED}))) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attached_tokens, sha256('') AS attachments_sha256
FROM c GROUP BY conv_id""",
    "op9_warc": f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS hex, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (({_BYTE5} >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f""",
    "op11_prefix_trie": """
WITH RECURSIVE crc(c, i, v) AS (
  SELECT conv_id, 0, CAST(4294967295 AS BIGINT) FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
  UNION ALL
  SELECT c, i + 1, CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END FROM (
    SELECT c, i, CASE WHEN i % 8 = 0 THEN xor(v, CAST(ascii(substr(CAST(c AS VARCHAR), 1 + i // 8, 1)) AS BIGINT)) ELSE v END AS b FROM crc WHERE i < 8 * length(CAST(c AS VARCHAR)))),
h AS (SELECT c, xor(v, 4294967295) % 6 AS h FROM crc WHERE i = 8 * length(CAST(c AS VARCHAR))),
o AS (SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
r AS (SELECT o.c, list_concat(coalesce(b.turns, [])[1:h.h], o.turns[h.h + 1:]) AS turns FROM o JOIN h USING (c) LEFT JOIN o b ON b.c = o.c - o.c % 100),
m AS (SELECT c, d, turns[1:d] AS path, d = len(turns) AS ends FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY path, d),
k AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(path[d].text) ELSE 0 END AS saved FROM n LEFT JOIN k USING (path)),
s AS (SELECT path[1:a] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM v) GROUP BY 1)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (path) LEFT JOIN v p ON v.d > 0 AND p.path = v.path[1:v.d - 1]""",
    "op12_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWERED}, '{_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, k, list_slice(w, p + 1, p + k) AS win FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS p FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, p, list_slice(w, p + 1, p + k) AS win FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM d, ks WHERE len(w) >= k)),
o AS (SELECT doc_id, p, dw.k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS p FROM o) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
