"""The registered queries ``opN_<name>`` of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_dedup
from .html_extract import extract_pages
from .language_id import fit_on, held_out, identify_languages
from .line_dedup import line_dedup
from .media import media_columns
from .mixing import mix_sources
from .ngram_jaccard import jaccard_groups
from .packing import pack_documents
from .pii import pseudonymise
from .prefix_trie import prefix_trie
from .simhash import simhash_groups
from .target_resampling import BUCKETS, resample
from .token_count import token_counts


def tokenizer(name: str) -> str:
    """Where the public tokenizers are installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), weights=(1, 2, 3), limit=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "shards")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


#: The key of the registered query; a deployment gives its own.
PII_KEY = "example key of the registered query"


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "text", F.col("lines_removed").cast("long").alias("lines_removed"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), shingle=3, distance=2)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = media_columns(table(spark, sf_dir, "documents"))
    return media.drop("media").withColumn("feature", F.lower(F.hex("feature")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_on(docs, ~held_out("doc_id"), "doc_id", "text", "lang")
    found = identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1)


def op10_extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=25, least=20, seed=7)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), words=3)


QUERIES = [
    op1_exact_dedup, op2_mix_sources, op3_token_counts, op4_pseudonyms, op5_line_dedup, op6_simhash, op7_media_columns,
    op8_language_id, op9_pack_documents, op10_extract_pages, op11_target_resampling, op12_prefix_trie,
    op13_ngram_jaccard,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x,
         unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents),
full_lines AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nr FROM lines
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
windows AS (
  SELECT a.doc_id, a.nr, [a.i, b.i, c.i] AS own, a.x || chr(10) || b.x || chr(10) || c.x AS key
  FROM full_lines a
  JOIN full_lines b ON b.doc_id = a.doc_id AND b.nr = a.nr + 1
  JOIN full_lines c ON c.doc_id = a.doc_id AND c.nr = a.nr + 2),
ranked AS (
  SELECT *, row_number() OVER same AS r, first_value(doc_id) OVER same AS first_doc, first_value(nr) OVER same AS first_nr
  FROM windows WINDOW same AS (PARTITION BY key ORDER BY doc_id, nr)),
covered AS (
  SELECT DISTINCT doc_id, i
  FROM (SELECT *, unnest(own) AS i, nr + unnest([0, 1, 2]) AS own_nr FROM ranked WHERE r > 1)
  WHERE doc_id <> first_doc OR own_nr >= first_nr + 3)
SELECT l.doc_id, coalesce(string_agg(l.x, chr(10) ORDER BY l.i) FILTER (WHERE c.i IS NULL), '') AS text,
       count(c.i) AS lines_removed
FROM lines l LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.i = l.i
GROUP BY l.doc_id
UNION ALL SELECT doc_id, NULL, 0 FROM documents WHERE text IS NULL
"""


#: A table of one row that a CRC-32 in SQL looks up: what each byte does, by the polynomial of zlib.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: xor(a >> 1, 3988292384 * (a & 1)))) AS t"


def crc_sql(data: str) -> str:
    """The CRC-32 of a string's UTF-8 bytes, with ``CRC_TABLE`` at hand as ``t``."""
    digit = "strpos('0123456789ABCDEF', {0}) - 1".format
    octets = f"list_transform(range(1, len(hex(encode({data}))), 2), lambda i: 16 * ({digit(f'hex(encode({data}))[i]')}) + {digit(f'hex(encode({data}))[i + 1]')})"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])))"


OP11_SQL = rf"""
WITH crc_table AS MATERIALIZED ({CRC_TABLE}),
texts AS (
  SELECT 'own' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'target', item_id, text FROM benchmark),
words AS (
  SELECT side, id, unnest(own) AS word, unnest(range(len(own))) AS i
  FROM (SELECT side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS own FROM texts)),
pairs AS (SELECT side, id, word, lead(word) OVER (PARTITION BY side, id ORDER BY i) AS next FROM words),
features AS MATERIALIZED (
  SELECT side, id, word AS feature FROM pairs UNION ALL SELECT side, id, word || ' ' || next FROM pairs WHERE next IS NOT NULL),
hashed AS MATERIALIZED (SELECT feature, {crc_sql("feature")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT feature FROM features), crc_table),
dealt AS MATERIALIZED (SELECT side, id, bucket FROM features JOIN hashed USING (feature)),
counts AS (SELECT bucket, count(*) FILTER (WHERE side = 'own') AS s, count(*) FILTER (WHERE side = 'target') AS t FROM dealt GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + {BUCKETS})::DOUBLE)
                              / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM counts),
sums AS (SELECT id, count(*) AS n, sum(gain)::BIGINT AS worth FROM dealt JOIN gains USING (bucket) WHERE side = 'own' GROUP BY id),
sizes AS (SELECT id, count(*) AS w FROM words WHERE side = 'own' GROUP BY id),
noise AS (SELECT doc_id, floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS g FROM documents),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce((worth - ((worth % n) + n) % n) // n, 0) AS weight, g, coalesce(w, 0) AS w
  FROM documents d JOIN noise USING (doc_id) LEFT JOIN sums ON sums.id = d.doc_id LEFT JOIN sizes ON sizes.id = d.doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY weight + g DESC, doc_id) AS r FROM scored WHERE w >= 20)
SELECT doc_id, n_features, weight, weight + g AS score, CASE WHEN r <= 25 * (SELECT count(*) FROM ranked) // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""

OP12_SQL = rf"""
WITH crc_table AS MATERIALIZED ({CRC_TABLE}),
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS nr
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own), crc_table),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, nr, role, text FROM convs c JOIN own t ON t.conv_id = c.base AND nr <= h
  UNION ALL SELECT c.conv_id, 1, nr, role, text FROM convs c JOIN own t ON t.conv_id = c.conv_id AND nr > h),
paths AS MATERIALIZED (
  SELECT conv_id, row_number() OVER w AS d, list({{'role': role, 'text': text}}) OVER w AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, nr)
  UNION ALL SELECT conv_id, 0, [], 0 FROM convs),
nodes AS MATERIALIZED (SELECT key, min(d) AS d, min(conv_id) AS conv, count(*) AS n, min(words) AS words FROM paths GROUP BY key),
children AS (SELECT list_slice(key, 1, d - 1) AS key, count(*) AS c, min(d) AS d FROM nodes WHERE d > 0 GROUP BY 1),
valued AS (SELECT n.*, coalesce(c, 0) AS children, CASE WHEN c IS NULL THEN 1 ELSE 0 END AS leaf, (n - 1) * words AS saved FROM nodes n LEFT JOIN children c ON c.key = n.key),
below AS (SELECT a.key, sum(leaf)::BIGINT AS leaves, sum(saved)::BIGINT AS saved FROM valued v JOIN paths a ON a.conv_id = v.conv AND a.d <= v.d GROUP BY a.key),
ends AS (
  SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha
  FROM (SELECT conv_id, arg_max(key, d) AS key FROM paths GROUP BY conv_id) GROUP BY key)
SELECT v.conv AS conv_id, v.d AS depth, p.conv AS parent_conv_id, v.n AS n_convs, v.children AS n_children, b.leaves AS n_leaves, b.saved AS saved_tokens,
       coalesce(sha, sha256('')) AS ends_sha256
FROM valued v JOIN below b ON b.key = v.key LEFT JOIN ends e ON e.key = v.key LEFT JOIN nodes p ON v.d > 0 AND p.key = list_slice(v.key, 1, v.d - 1)
"""

OP13_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, unnest(own) AS word, unnest(range(len(own))) AS i, len(own) AS m
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS own FROM documents)),
followed AS (SELECT *, lead(word) OVER w AS second, lead(word, 2) OVER w AS third FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, word || ' ' || second || ' ' || third AS gram FROM followed WHERE third IS NOT NULL
  UNION ALL SELECT doc_id, word || coalesce(' ' || second, '') FROM followed WHERE m < 3 AND i = 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM grams a JOIN grams b ON b.gram = a.gram AND b.doc_id > a.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reach AS (
  SELECT doc_id AS node, doc_id AS start FROM documents
  UNION SELECT l.b, r.start FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT node AS doc_id, min(start) AS component_id FROM reach GROUP BY node) USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL, "op5_line_dedup": OP5_SQL, "op11_target_resampling": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_ngram_jaccard": OP13_SQL,
    }
