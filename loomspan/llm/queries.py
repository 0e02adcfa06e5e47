"""The contract queries opN_<name> of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archives, conversation_trie, exact_dedup, html_text, language_model, mixing, packing, phrases, pii, quality, simhash, token_counts, urls
from .common import table

TOKENIZER, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extracted(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.articles(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.sequences(table(spark, sf_dir, "conversations"), group=5)
    return conversation_trie.prefix_trie(conversation_trie.spliced(turns, at_most=8))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.prefix_counts(table(spark, sf_dir, "documents"), tokenizer(PIECES))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


# A-Z only: translate() is exact in DuckDB too.
OP4 = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1)
  GROUP BY doc_id
), m AS (
  SELECT d.doc_id, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS up, length(regexp_replace(t, '\P{L}+', '', 'g')) AS letters,
         len(string_split(t, chr(10))) AS n_lines
  FROM d LEFT JOIN rep USING (doc_id)
), v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN n_words * 1.5 AND n_words * 30.0 AND n_symbols <= n_words * 0.1
       AND up <= 0.6 * letters AND n_dup_lines <= n_lines * 0.7 AS kept
FROM v
"""

# Base 32 of the 160 bits: group i lies in the hexadecimal digits 5 i / 4 and the next.
OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) || '0' AS x FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, strlen(h) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((16 * (strpos('0123456789abcdef', substr(x, CAST(1 + 5 * i // 4 AS bigint), 1)) - 1) + strpos('0123456789abcdef', substr(x, CAST(2 + 5 * i // 4 AS bigint), 1)) - 1) >> CAST(3 - (5 * i) % 4 AS int)) & 31) AS bigint), 1)), '') AS payload_digest,
       CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to
FROM m
"""

# Equal lists of words are equal phrases; hugeint holds the products.
OP11 = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d
), g AS (
  SELECT lang, k, w[i : i + k - 1] AS g, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= 100
), t AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
cut AS (
  SELECT c.lang, c.k, c.g, c.f AS a, l.f AS l, r.f AS r, t.n, j,
         CAST(1000 * CAST(c.f AS hugeint) * t.n // (CAST(l.f AS hugeint) * r.f) AS bigint) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM g WHERE k > 1) c
  JOIN t ON c.lang = t.lang
  JOIN g l ON l.lang = c.lang AND l.g = c.g[1 : j]
  JOIN g r ON r.lang = c.lang AND r.g = c.g[j + 1 : c.k]
), low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
held AS (
  SELECT DISTINCT x.lang, x.part
  FROM (SELECT lang, f, unnest([g[1 : k - 1], g[2 : k]]) AS part FROM g WHERE k > 2) x JOIN g s ON s.lang = x.lang AND s.g = x.part
  WHERE 100 * x.f >= 100 * s.f
), ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, CAST(n AS bigint) AS n, score
  FROM low WHERE NOT EXISTS (SELECT 1 FROM held WHERE held.lang = low.lang AND held.part = low.g)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM ranked QUALIFY rank <= 2000
"""

# CRC-32 bit by bit: 3988292384 is its polynomial. A node is a list of turns.
OP12 = r"""
WITH t AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT conv_id, s,
         xor(list_reduce(flatten(list_transform(range(1, len(CAST(conv_id AS varchar)) + 1), lambda i: [ord(substr(CAST(conv_id AS varchar), i, 1)), 0, 0, 0, 0, 0, 0, 0])),
             lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), 4294967295), 4294967295) % 9 AS h
  FROM t
), c AS (
  SELECT h.conv_id, list_concat(coalesce(b.s, [])[1 : h.h], h.s[h.h + 1 :]) AS s FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 5
), p AS (
  SELECT conv_id, d, s[1 : d] AS p, len(s) = d AS ends FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM c)
), n AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(strlen(p[d].text), 0) AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS varchar), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM p GROUP BY p, d
), k AS (SELECT p[1 : d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
below AS (
  SELECT p[1 : a] AS p, a AS d, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS bigint) AS saved_tokens
  FROM (SELECT n.*, n_children, unnest(range(0, d + 1)) AS a FROM n LEFT JOIN k USING (p)) GROUP BY 1, 2
)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN below ON below.p = n.p AND below.d = n.d LEFT JOIN k ON k.p = n.p LEFT JOIN n up ON up.d = n.d - 1 AND up.p = n.p[1 : n.d - 1]
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_warc": OP9, "op4_exact_dedup": OP4, "op10_quality_cascade": OP10, "op11_phrases": OP11, "op12_conversation_trie": OP12}
