"""Registered queries of the operators and the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    compression_bands, conversation_trie, decontaminate, equal_average, language, mixing, partenum, quality, suffix_dedup, topk,
    toxicity, url_filter, warc)
from .common import table

RULES = [
    url_filter.Rule("com", "/", "allow"), url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"), url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block")]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", "n_bytes", "n_removed", "n_spans", suffix_dedup.kept_hash().alias("kept_sha256"))


def op2_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans", "items")


def op3_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document stands in a mixture of all sources with equal weights."""
    return mixing.mix(table(spark, sf_dir, "documents"), columns=["doc_id"])


def op5_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select(*warc.columns_of())


def op8_url_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op9_subword_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_partenum_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document."""
    found = partenum.jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op11_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts, repetition and the verdict on every document; a null text has no words and is not kept."""
    found = compression_bands.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", *compression_bands.COUNTS, "base_failed", "kept", "ratio", "n_chunks", "n_bad_chunks", "reason")


def op12_equal_average_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every usable vector, and the digest of the codebooks."""
    return equal_average.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    turns = conversation_trie.numbered(table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(*conversation_trie.rebuilt(turns))


OP2_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS seq
  FROM item_words, unnest(generate_series(1, greatest(1, len(w) - 9))) AS u(i) WHERE len(w) > 0),
places AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS seq
  FROM doc_words, (SELECT DISTINCT n FROM windows), unnest(generate_series(1, len(w) - n + 1)) AS u(i)),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, seq)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(generate_series(i, i + n - 1)) AS u(p) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP3_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP7_SQL = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, upper(sha1(coalesce(html, ''))) AS hex FROM pages),
bits AS (
  SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda h:
           ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101',
            '1110', '1111'][strpos('0123456789ABCDEF', h)]), '') AS digits FROM hashed),
coded AS (
  SELECT page_id, payload, array_to_string(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j:
             CAST(substr(digits, 5 * i + j + 1, 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER))) AS INTEGER), 1)), '')
         AS payload_digest FROM bits),
firsts AS (SELECT payload, min(page_id) AS first_id FROM coded GROUP BY payload)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM coded JOIN firsts USING (payload)
"""

OP8_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
          ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS r(rh, rp, rv)),
fits AS (
  SELECT page_id, host, path, rh || rp AS name, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS n
  FROM parts LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, name AS rule, coalesce(rv, 'allow') AS verdict FROM fits WHERE n = 1
"""

OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s
  FROM words, unnest(generate_series(1, greatest(1, len(w) - 3))) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM roots LEFT JOIN sizes USING (doc_id)
"""

_NEAREST = """
  SELECT vec_id, label, p, x, m % 64 AS e, m // 64 AS dist FROM (
    SELECT vec_id, label, a.p, x, min(64 * CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))
                                            AS BIGINT) + e) AS m
    FROM parts a JOIN {books} b ON a.p = b.p GROUP BY ALL)"""
_MEANS = """
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN (
    SELECT p, e, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
      SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM {coded}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY p, e, i)
    GROUP BY p, e) m ON m.p = b.p AND m.e = b.e"""
OP12_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, p, list_slice(v, p * d + 1, (p + 1) * d) AS x
  FROM (SELECT *, len(v) // 16 AS d FROM kept), range(0, 16) AS t(p)),
books0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
coded0 AS MATERIALIZED ({_NEAREST.format(books="books0")}),
books1 AS MATERIALIZED ({_MEANS.format(books="books0", coded="coded0")}),
coded1 AS MATERIALIZED ({_NEAREST.format(books="books1")}),
books2 AS MATERIALIZED ({_MEANS.format(books="books1", coded="coded1")}),
coded2 AS MATERIALIZED ({_NEAREST.format(books="books2")}),
codes AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error
  FROM coded2 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM books2) AS codebooks_sha256
FROM codes
"""

OP13_SQL = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS idx
  FROM conversations WHERE conv_id IS NOT NULL),
counts AS (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS family, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 9 AS h FROM counts),
taken AS (SELECT c.conv_id, family, h, least(h, coalesce(n, 0)) AS m FROM convs c LEFT JOIN counts f ON f.conv_id = c.family),
turns AS (
  SELECT t.conv_id, o.idx AS pos, role, text FROM taken t JOIN own o ON o.conv_id = t.family AND o.idx <= t.h
  UNION ALL SELECT t.conv_id, m + o.idx - h, role, text FROM taken t JOIN own o ON o.conv_id = t.conv_id AND o.idx > t.h),
seqs AS (
  SELECT c.conv_id, coalesce(s, []) AS s FROM convs c
  LEFT JOIN (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY pos) AS s FROM turns GROUP BY conv_id) t USING (conv_id)),
places AS (
  SELECT conv_id, d, len(s) AS n_turns, list_slice(s, 1, d) AS path, coalesce(strlen(s[d].text), 0) AS size
  FROM seqs, LATERAL (SELECT unnest(range(0, len(s) + 1)) AS d)),
members AS (
  SELECT conv_id, d, n_turns, size, min(conv_id) OVER (PARTITION BY d, path) AS node, count(*) OVER (PARTITION BY d, path) AS n FROM places),
nodes AS (
  SELECT node, d, any_value(n) AS n, any_value(size) AS size, max(n_turns) = d AS childless,
         string_agg(CASE WHEN n_turns = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends
  FROM members GROUP BY node, d),
parents AS (
  SELECT u.node, u.d, p.node AS parent FROM nodes u JOIN members p ON p.conv_id = u.node AND p.d = u.d - 1),
kids AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM parents GROUP BY 1, 2),
below AS (
  SELECT a.node, a.d, sum((u.n - 1) * u.size) AS saved, count(*) FILTER (WHERE childless) AS leaves
  FROM nodes u JOIN members a ON a.conv_id = u.node AND a.d <= u.d GROUP BY a.node, a.d)
SELECT node AS conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM nodes LEFT JOIN parents USING (node, d) LEFT JOIN kids USING (node, d) JOIN below USING (node, d)
"""

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_positional_index": op2_positional_index,
    "op3_bit_sliced_top_k": op3_bit_sliced_top_k,
    "op4_pfair_mixing": op4_pfair_mixing,
    "op5_positive_unlabelled": op5_positive_unlabelled,
    "op6_cross_parsing": op6_cross_parsing,
    "op7_warc_bundles": op7_warc_bundles,
    "op8_url_globs": op8_url_globs,
    "op9_subword_softmax": op9_subword_softmax,
    "op10_partenum_components": op10_partenum_components,
    "op11_compression_bands": op11_compression_bands,
    "op12_equal_average_codes": op12_equal_average_codes,
    "op13_conversation_trie": op13_conversation_trie,
}
ORACLES = {"op2_positional_index": OP2_SQL, "op3_bit_sliced_top_k": OP3_SQL, "op7_warc_bundles": OP7_SQL, "op8_url_globs": OP8_SQL,
           "op10_partenum_components": OP10_SQL, "op12_equal_average_codes": OP12_SQL, "op13_conversation_trie": OP13_SQL}
