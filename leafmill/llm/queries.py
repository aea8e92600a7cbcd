"""The registered queries of the training-data operators, and the DuckDB SQL where SQL can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, byte_cnn, chat, fm_index, gated_lm, licenses, multi_index, nbsvm, order_minhash, resample, toxicity, variants, warc
from .shared import fold, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def registered(f):
    QUERIES[f.__name__] = f
    return f


@registered
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode(coded, ranks).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@registered
def op5_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


ORACLES["op5_fm_index"] = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_sized AS (
  SELECT item, w, least(10, len(w)) AS size FROM item WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM item_sized)
), sizes AS (
  SELECT DISTINCT size FROM windows
), doc_windows AS (
  SELECT row_no, size, i, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT row_no, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, sizes WHERE len(w) >= size)
), hits AS (
  SELECT row_no, i, size, item FROM doc_windows JOIN windows USING (size, phrase)
), hit_words AS (
  SELECT row_no, count(DISTINCT word) AS n_hit FROM (SELECT row_no, unnest(range(i, i + size)) AS word FROM hits) GROUP BY row_no
), hit_items AS (
  SELECT row_no, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_no, item FROM hits) GROUP BY row_no
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (row_no) LEFT JOIN hit_items USING (row_no)
"""


@registered
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.capture_histories(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "intact")


ORACLES["op6_warc"] = r"""
WITH page AS (
  SELECT page_id, lower(trim(url)) AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), part AS (
  SELECT *, '^(?:[a-z][a-z0-9+.-]*://)?(?:www\.)?([^/?#:]*)(?::\d+)?([^#]*)' AS shape, page_id IS DISTINCT FROM first AS revisit FROM page
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN first END AS refers_to,
       CASE WHEN url IS NULL THEN ')/' ELSE regexp_replace(concat(array_to_string(list_reverse(string_split(regexp_extract(url, shape, 1), '.')), ','), ')', coalesce(nullif(regexp_extract(url, shape, 2), ''), '/')), '[\r\n]', '', 'g') END AS url_key,
       strftime(TIMESTAMP '2024-01-01' + to_seconds(((coalesce(page_id, 0) % 300000000) + 300000000) % 300000000), '%Y-%m-%dT%H:%M:%SZ') AS ts, true AS intact
FROM part
"""


@registered
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


ORACLES["op7_chat"] = r"""
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
), marked AS (
  SELECT *, md5(concat(pos, '|', role IS NULL, '|', coalesce(role, ''), '|', text IS NULL, '|', coalesce(text, ''))) AS h FROM turns
), prefix AS (
  SELECT conv_id, pos, string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY pos) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM marked
), whole AS (
  SELECT p, n, min(conv_id) AS conv_id FROM prefix WHERE pos = n GROUP BY p, n
), kept AS (
  SELECT conv_id, n FROM whole WHERE p NOT IN (SELECT p FROM prefix WHERE pos < n)
)
SELECT t.conv_id, CAST((t.pos - 1) // 1024 AS BIGINT) AS part, CAST(k.n AS BIGINT) AS n_turns,
       string_agg(concat('<|', coalesce(role, 'unknown'), '|>', chr(10), coalesce(text, ''), chr(10), '<|end|>', chr(10)), '' ORDER BY t.pos) AS text
FROM turns t JOIN kept k ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL
"""


@registered
def op4_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = nbsvm.scored(docs, nbsvm.learn(docs, table(spark, sf_dir, "labels")), out="score")
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@registered
def op8_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = byte_cnn.identified(docs.select("doc_id", "text"), byte_cnn.learn(docs))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@registered
def op9_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), out="score")
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@registered
def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@registered
def op1_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_lm.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


@registered
def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return multi_index.neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))


#: crc32 of column `hex`, the hexadecimal bytes, as SQL; `tab` is CRC_TABLE's list.
CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(hex) // 2), lambda k: CAST('0x' || substr(hex, 2 * k + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
CRC_TABLE = "SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@registered
def op11_variable_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op11_variable_grams"] = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}
), run AS (
  SELECT w, hex(encode(concat(doc_id, ':', w))) AS hex, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY ALL
), hashed AS (
  SELECT w, times, {CRC} AS h FROM run, crc
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN concat(substr(w, 1, CAST(h % length(w) AS BIGINT)), substr(w, CAST(h % length(w) + 2 AS BIGINT))) ELSE w END AS word, CAST(sum(times) AS BIGINT) AS n FROM hashed GROUP BY 1
), vocabulary AS MATERIALIZED (
  SELECT word, n FROM words WHERE length(word) >= 7 AND n >= 2
), shorter AS (
  SELECT DISTINCT word, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)
), near AS (
  SELECT a.word, b.word AS other FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, v.word FROM shorter s JOIN vocabulary v ON s.rest = v.word
  UNION SELECT v.word, s.word FROM shorter s JOIN vocabulary v ON s.rest = v.word
), best AS (
  SELECT a.word, a.n, count(*) AS n_near, first(b.word ORDER BY b.n DESC, b.word) AS top, max(b.n) AS top_n
  FROM near JOIN vocabulary a ON near.word = a.word JOIN vocabulary b ON near.other = b.word GROUP BY ALL
), forms AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 10 * n THEN top END AS form, CASE WHEN top_n >= 10 * n THEN top_n END AS form_n FROM vocabulary LEFT JOIN best USING (word, n)
), path AS (
  SELECT word, word AS at FROM forms UNION ALL SELECT p.word, f.form FROM path p JOIN forms f ON p.at = f.word WHERE f.form IS NOT NULL
), roots AS (
  SELECT p.word, p.at AS root FROM path p JOIN forms f ON p.at = f.word WHERE f.form IS NULL
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM forms JOIN roots USING (word)
"""


@registered
def op12_rare_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _sql_list(items: list[bytes]) -> str:
    return "[" + ", ".join(f"'{w.decode()}'" for w in items) + "]"


TEMPLATE_ROWS = ", ".join(
    f"('{t.label}', {t.base}, {_sql_list(t.words)}, [" + ", ".join(f"{{'at': {at}, 'w': {_sql_list(phrase)}}}" for at, phrase in t.phrases) + "])" for t in licenses.TEMPLATES
)
ORACLES["op12_rare_words"] = rf"""
WITH template AS (
  SELECT label, base, tw, phrases, tw[1] AS first FROM (VALUES {TEMPLATE_ROWS}) AS t(label, base, tw, phrases)
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), begun AS (
  SELECT r, i, w[i : i + 63] AS w FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM doc) WHERE w[i] IN (SELECT first FROM template)
), placed AS (
  SELECT r, label, base, i - 1 AS start, len(list_filter(range(1, len(tw) + 1), lambda k: w[k] = tw[k])) / len(tw) AS share
  FROM begun JOIN template ON w[1] = first WHERE len(list_filter(phrases, lambda p: w[p.at + 1 : p.at + len(p.w)] = p.w)) = len(phrases)
), found AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM placed GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM doc LEFT JOIN found USING (r)
"""


@registered
def op13_prefix_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op13_prefix_crc"] = rf"""
WITH crc AS ({CRC_TABLE}
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), target AS (
  SELECT unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), feature AS MATERIALIZED (
  SELECT r, word, count(*) AS times FROM (SELECT r, unnest(w) AS word FROM doc) GROUP BY ALL
), bucket AS MATERIALIZED (
  SELECT word, {CRC} % 10000 AS b FROM (SELECT word, hex(encode(word)) AS hex FROM (SELECT word FROM feature UNION SELECT word FROM target)), crc
), s AS (
  SELECT b, sum(times) AS s FROM feature JOIN bucket USING (word) GROUP BY b
), t AS (
  SELECT b, count(*) AS t FROM target JOIN bucket USING (word) GROUP BY b
), gain AS (
  SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + CAST(1 AS DOUBLE)) * ((SELECT coalesce(sum(s), 0) FROM s) + CAST(10000 AS DOUBLE)) / ((coalesce(s, 0) + CAST(1 AS DOUBLE)) * ((SELECT coalesce(sum(t), 0) FROM t) + CAST(10000 AS DOUBLE))))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT b FROM bucket) LEFT JOIN s USING (b) LEFT JOIN t USING (b)
), weighed AS (
  SELECT r, CAST(floor(CAST(sum(times * gain) AS DOUBLE) / sum(times)) AS BIGINT) AS weight FROM feature JOIN bucket USING (word) JOIN gain USING (b) GROUP BY r
), scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256(concat('2024:', doc_id)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM doc LEFT JOIN weighed USING (r)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS place, count(*) FILTER (n_features >= 20) OVER () AS long FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * long // 100 THEN place END AS rank FROM ranked
"""
