"""Registered queries over collections and pages, with their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import documents as D
from leafmill.plans.registry import query
from leafmill.sources.store import shared_dir, write_by_key
from leafmill.sources.tables import SCHEMAS, as_declared, doc_pages, page_counts, table

PAGES = """doc_pages AS (
  SELECT source, doc_id, CAST(p + 1 AS INTEGER) AS page_no, array_to_string(lines[p * 10 + 1 : p * 10 + 10], chr(10)) AS text
  FROM (SELECT *, unnest(range(0, (len(lines) + 9) // 10)) AS p FROM (SELECT source, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), counts AS (SELECT source, doc_id, count(*) AS pages FROM doc_pages GROUP BY ALL)"""
SPECS = ["", "1-3, 5", "2-", "-2", "3 - 1", "9-12, abc"]
SPEC_SQL = "specs AS (SELECT doc_id, ['', '1-3, 5', '2-', '-2', '3 - 1', '9-12, abc'][doc_id % 6 + 1] AS spec FROM documents)"
SELECTED = f"""{PAGES}, {SPEC_SQL}, parts AS (
  SELECT s.doc_id, spec, pages, CASE WHEN trim(spec) = '' THEN ['1-' || pages] ELSE list_filter(list_transform(string_split(spec, ','), lambda x: trim(x)), lambda x: x <> '') END AS parts FROM specs s JOIN counts USING (doc_id)
), spans AS (
  SELECT doc_id, pages, part, regexp_matches(part, '^(\\d+\\s*(-\\s*\\d*)?|-\\s*\\d+)$') AS fine, split_part(part, '-', 1) AS a, CASE WHEN contains(part, '-') THEN split_part(part, '-', 2) ELSE part END AS b
  FROM (SELECT doc_id, pages, unnest(parts) AS part FROM parts)
), ends AS (
  SELECT doc_id, pages, fine, CASE WHEN fine THEN CASE WHEN trim(a) = '' THEN 1 ELSE CAST(trim(a) AS BIGINT) END END AS x, CASE WHEN fine THEN CASE WHEN trim(b) = '' THEN pages ELSE CAST(trim(b) AS BIGINT) END END AS y FROM spans
), good AS (
  SELECT doc_id FROM ends GROUP BY doc_id HAVING bool_and(fine AND least(x, y) >= 1 AND greatest(x, y) <= pages)
), selected AS (
  SELECT DISTINCT p.doc_id, p.page_no, p.text FROM doc_pages p JOIN good USING (doc_id) JOIN ends e ON p.doc_id = e.doc_id AND p.page_no BETWEEN least(x, y) AND greatest(x, y)
)"""


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def specs(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.element_at(F.array(*map(F.lit, SPECS)), (F.col("doc_id") % 6 + 1).cast("int")).alias("spec"))


def selected(spark: SparkSession, sf: str) -> DataFrame:
    return D.select_pages(doc_pages(docs(spark, sf)), page_counts(docs(spark, sf)), specs(spark, sf))[0]


@query(" UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS n_rows FROM {name}" for name in SCHEMAS))
def scan_tables(spark, sf):
    from functools import reduce

    from leafmill.sources.tables import load

    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in load(spark, sf).items()])


@query("SELECT doc_id, lang, coalesce(lang IN ('en', 'fr'), false) AS accepted FROM documents")
def intake_split(spark, sf):
    fine, rest = D.intake_split(docs(spark, sf).select("doc_id", "lang"), "lang", ["en", "fr"])
    return fine.withColumn("accepted", F.lit(True)).unionByName(rest.withColumn("accepted", F.lit(False)))


@query(f"""WITH {PAGES}, s AS (SELECT source, count(*) AS docs, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source), p AS (SELECT source, CAST(sum(pages) AS BIGINT) AS pages FROM counts GROUP BY source)
SELECT source, docs, pages, bytes, pages || CASE WHEN pages = 1 THEN ' page' ELSE ' pages' END || ' · ' || CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN printf(CASE WHEN bytes / 1024 < 10 THEN '%.1f KB' ELSE '%.0f KB' END, bytes / 1024) WHEN bytes < 1073741824 THEN printf(CASE WHEN bytes / 1048576 < 10 THEN '%.1f MB' ELSE '%.0f MB' END, bytes / 1048576) ELSE printf(CASE WHEN bytes / 1073741824 < 10 THEN '%.1f GB' ELSE '%.0f GB' END, bytes / 1073741824) END AS label
FROM s JOIN p USING (source)""")
def collection_summary(spark, sf):
    return D.collection_summary(docs(spark, sf))


MANIFEST = "manifest AS (SELECT url, min(sha256(coalesce(html, ''))) AS sha256 FROM pages WHERE url <> '/manifest.json' GROUP BY url)"


@query(f"WITH {MANIFEST} SELECT * FROM manifest")
def asset_manifest(spark, sf):
    return D.asset_manifest(table(spark, sf, "pages"))


@query(f"""WITH {MANIFEST}, b AS (SELECT substr(sha256(url), 1, 6) AS bucket, sha256(string_agg(url || ' ' || sha256, chr(10) ORDER BY url || ' ' || sha256)) AS h FROM manifest GROUP BY 1),
c AS (SELECT substr(bucket, 1, 3) AS upper, sha256(string_agg(h, '' ORDER BY bucket)) AS h FROM b GROUP BY 1)
SELECT substr(sha256(string_agg(h, '' ORDER BY upper)), 1, 12) AS build_id FROM c""")
def asset_build_id(spark, sf):
    return D.build_id(D.asset_manifest(table(spark, sf, "pages")))


SITEMAP = """a AS (SELECT '/' AS loc, 'monthly' AS changefreq, '1.0' AS priority UNION ALL SELECT DISTINCT '/tools/' || replace(lower(p_brand), '#', '-') || '/', 'monthly', '0.9' FROM part UNION ALL SELECT DISTINCT url, 'yearly', '0.5' FROM pages),
b AS (SELECT loc, max({'p': priority, 'c': changefreq}) AS best FROM a GROUP BY loc),
sitemap AS (SELECT loc, best.c AS changefreq, best.p AS priority, '<url><loc>' || loc || '</loc><changefreq>' || best.c || '</changefreq><priority>' || best.p || '</priority></url>' AS xml FROM b)"""


@query(f"WITH {SITEMAP} SELECT * FROM sitemap")
def sitemap_export(spark, sf):
    tag = lambda df, freq, priority: df.distinct().select("loc", F.lit(freq).alias("changefreq"), F.lit(priority).alias("priority"))
    home = spark.range(1).select(F.lit("/").alias("loc"))
    tools = table(spark, sf, "part").select(F.concat(F.lit("/tools/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")), F.lit("/")).alias("loc"))
    return D.sitemap_export(tag(home, "monthly", "1.0"), tag(tools, "monthly", "0.9"), tag(table(spark, sf, "pages").select(F.col("url").alias("loc")), "yearly", "0.5"))


@query(f"""WITH {SITEMAP}, r AS (SELECT *, row_number() OVER (ORDER BY loc) AS n FROM sitemap)
SELECT CAST((n - 1) // 300 AS BIGINT) AS shard, count(*) AS urls, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || chr(10) || string_agg(xml, chr(10) ORDER BY n) || chr(10) || '</urlset>' || chr(10) AS document FROM r GROUP BY (n - 1) // 300""")
def sitemap_files(spark, sf):
    return D.sitemap_files(sitemap_export(spark, sf), 300)


RUNNING = """rows AS (
  SELECT source, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, md5(text) AS mark FROM documents
), starts AS (
  SELECT source, doc_id, lines, coalesce(sum((len(lines) + 9) // 10) OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, mark NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM rows
), numbered AS (
  SELECT source, doc_id, CAST(p + 1 AS INTEGER) AS page_no, CAST(start + p + 1 AS BIGINT) AS running_no, array_to_string(lines[p * 10 + 1 : p * 10 + 10], chr(10)) AS text FROM (SELECT *, unnest(range(0, (len(lines) + 9) // 10)) AS p FROM starts)
)"""


@query(f"WITH {RUNNING} SELECT * FROM numbered")
def paginate(spark, sf):
    return D.paginate_own(docs(spark, sf))


@query(f"WITH {RUNNING} SELECT source, CAST((running_no - 1) // 1000 AS BIGINT) AS part, count(*) AS pages, string_agg('[' || running_no || ']' || chr(10) || text, chr(10) ORDER BY running_no) AS text FROM numbered GROUP BY source, (running_no - 1) // 1000")
def merge_collection(spark, sf):
    return D.merge_collection(D.paginate_own(docs(spark, sf)), label=True)


@query(f"WITH {SELECTED} SELECT doc_id, page_no, text FROM selected")
def select_pages(spark, sf):
    return selected(spark, sf)


@query(f"""WITH {PAGES}, {SPEC_SQL}, parts AS (
  SELECT s.doc_id, spec, pages, CASE WHEN trim(spec) = '' THEN ['1-' || pages] ELSE list_filter(list_transform(string_split(spec, ','), lambda x: trim(x)), lambda x: x <> '') END AS parts FROM specs s JOIN counts USING (doc_id)
), spans AS (SELECT doc_id, spec, pages, unnest(parts) AS part FROM parts
), ends AS (
  SELECT *, regexp_matches(part, '^\\d+\\s*(-\\s*\\d+)?$') AS fine, CAST(regexp_extract(part, '^(\\d+)', 1) AS VARCHAR) AS a, CASE WHEN contains(part, '-') THEN regexp_extract(part, '(\\d+)$', 1) ELSE regexp_extract(part, '^(\\d+)', 1) END AS b FROM spans
), judged AS (
  SELECT doc_id, spec, bool_and(fine) AS fine, bool_and(fine AND (greatest(try_cast(a AS BIGINT), try_cast(b AS BIGINT)) < 1 OR least(try_cast(a AS BIGINT), try_cast(b AS BIGINT)) > pages)) AS gone FROM ends GROUP BY ALL
), none AS (SELECT doc_id, spec FROM parts WHERE len(parts) = 0)
SELECT doc_id, spec, 'empty' AS reason FROM none UNION ALL SELECT doc_id, spec, CASE WHEN NOT fine THEN 'invalid' ELSE 'out of range' END FROM judged WHERE NOT fine OR gone""")
def select_pages_errors(spark, sf):
    return D.select_pages(doc_pages(docs(spark, sf)), page_counts(docs(spark, sf)), specs(spark, sf), "clamping")[1]


@query(f"""WITH {SELECTED}, runs AS (SELECT doc_id, page_no, page_no - row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS island FROM selected), r AS (SELECT doc_id, min(page_no) AS lo, max(page_no) AS hi FROM runs GROUP BY doc_id, island)
SELECT doc_id, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS range_text FROM r GROUP BY doc_id""")
def page_ranges(spark, sf):
    return D.page_ranges(selected(spark, sf))


def file_name():
    return F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".PDF"))


@query(f"WITH {SELECTED} SELECT doc_id, 'doc' || doc_id || '-extracted' AS filename, string_agg(text, chr(10) ORDER BY page_no) AS text FROM selected GROUP BY doc_id")
def split_documents(spark, sf):
    return D.split_documents(selected(spark, sf), file_name(), "combined")


@query(f"WITH {SELECTED} SELECT doc_id, 'doc' || doc_id || '-page-' || page_no AS filename, text FROM selected")
def split_documents_separate(spark, sf):
    return D.split_documents(selected(spark, sf), file_name(), "separate")


@query(f"""WITH {PAGES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY -page_no) AS INTEGER) AS out_no, page_no, CAST((doc_id % 4 * 90 + CASE WHEN page_no % 2 = 0 THEN 90 ELSE 0 END) % 360 AS BIGINT) AS angle, text FROM doc_pages WHERE page_no % 3 <> 2""")
def edit_pages(spark, sf):
    pages = doc_pages(docs(spark, sf)).withColumn("angle", F.col("doc_id") % 4 * 90)
    keys = pages.select("doc_id", "page_no")
    return D.edit_pages(pages, keys.withColumn("pos", -F.col("page_no")), keys.where("page_no % 3 = 2"), keys.where("page_no % 2 = 0").withColumn("delta", F.lit(90)))


@query(f"WITH {SELECTED} SELECT doc_id, page_no FROM doc_pages WHERE (doc_id, page_no) NOT IN (SELECT (doc_id, page_no) FROM selected)")
def invert_selection(spark, sf):
    return D.invert_selection(doc_pages(docs(spark, sf)), selected(spark, sf))


BOXES = f"{PAGES}, boxes AS (SELECT doc_id, page_no, 600 + length(text) % 101 AS w, 800 + page_no % 7 * 10 AS h FROM doc_pages)"


@query(f"""WITH {BOXES} SELECT doc_id, page_no, CAST(floor((max(w) OVER d - w) / 2 + 0.5) AS BIGINT) AS x, CAST(coalesce(sum(h) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y,
CAST(max(w) OVER d AS INTEGER) AS canvas_w, CAST(sum(h) OVER d AS BIGINT) AS canvas_h FROM boxes WINDOW d AS (PARTITION BY doc_id)""")
def stack_layout(spark, sf):
    return D.stack_layout(doc_pages(docs(spark, sf)).select("doc_id", "page_no", (600 + F.length("text") % 101).alias("w"), (800 + F.col("page_no") % 7 * 10).alias("h")))


@query("""WITH u AS (SELECT user_id AS job, CASE WHEN event_type = 'click' THEN 1 ELSE 2 END AS phase, event_id AS seq FROM events),
d AS (SELECT *, row_number() OVER (PARTITION BY job, phase ORDER BY seq) / count(*) OVER (PARTITION BY job, phase) AS done, min(phase) OVER (PARTITION BY job) < max(phase) OVER (PARTITION BY job) AS two FROM u)
SELECT job, phase, seq, CASE WHEN NOT two THEN done WHEN phase = 1 THEN done * CAST(0.4 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) + done * CAST(0.6 AS DOUBLE) END AS fraction FROM d""")
def job_progress(spark, sf):
    return D.job_progress(table(spark, sf, "events").select(F.col("user_id").alias("job"), F.when(F.col("event_type") == "click", 1).otherwise(2).alias("phase"), F.col("event_id").alias("seq")))


@query("""SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, ''), CASE WHEN event_id % 2 = 0 THEN 'whiteout' END, 'blackout') AS type,
coalesce(CASE WHEN event_id % 5 > 0 THEN nullif(CASE WHEN event_id % 4 > 0 THEN 'check' ELSE '' END, '') END, 'cross') AS mark FROM events""")
def migrate_records(spark, sf):
    old = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("type"), F.when(F.col("event_id") % 2 == 0, "whiteout").alias("style"),
        F.when(F.col("event_id") % 5 > 0, F.when(F.col("event_id") % 4 > 0, "check").otherwise("")).alias("mark"), F.lit("cross").alias("symbol_type"),
    )
    return D.migrate_records(old)


FILES = "files AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey || '.pdf' ELSE o_orderkey || '-' || strftime(o_orderdate, '%Y-%m-%d') || '.pdf' END AS name, o_orderdate FROM orders)"


def files(spark, sf):
    key = F.col("o_orderkey").cast("string")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(key, F.lit(".pdf"))).otherwise(F.concat(key, F.lit("-"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".pdf")))
    return table(spark, sf, "orders").select("o_orderkey", name.alias("name"), F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))


@query(f"""WITH {FILES}, k AS (SELECT *, array_to_string(list_transform(regexp_extract_all(lower(name), '\\d+|\\D+'), lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN lpad(CAST(length(regexp_replace(x, '^0+([0-9])', '\\1')) AS VARCHAR), 10, '0') || regexp_replace(x, '^0+([0-9])', '\\1') ELSE x END), '') AS key FROM files)
SELECT o_orderkey, name, row_number() OVER (ORDER BY key DESC, o_orderkey DESC) AS rank FROM k""")
def sort_natural(spark, sf):
    return D.sort_natural(files(spark, sf).select("o_orderkey", "name"), "name", "o_orderkey", descending=True)


@query(f"""WITH {FILES}, k AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(name, '\\d{{4}}-\\d{{2}}-\\d{{2}}'), '') AS TIMESTAMP), CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END, o_orderdate) AS sort_ts FROM files)
SELECT o_orderkey, name, CAST(sort_ts AS TIMESTAMP) AS sort_ts, row_number() OVER (ORDER BY sort_ts, o_orderkey) AS rank FROM k""")
def sort_by_date(spark, sf):
    found = files(spark, sf).withColumn("created", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")))
    return D.sort_by_date(found, "name", "created", "o_orderdate", "o_orderkey").select("o_orderkey", "name", "sort_ts", "rank")


@query("""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN n_chars || '?' ELSE CAST(n_chars AS VARCHAR) END AS n_chars, CASE WHEN doc_id % 9 = 0 THEN 'n_chars' ELSE '' END AS uncast FROM documents WHERE n_chars IS NOT NULL OR doc_id % 9 > 0""")
def declared_read(spark, sf):
    found = docs(spark, sf)
    text = F.col("n_chars").cast("string")
    found = found.withColumn("n_chars", F.when(F.col("doc_id") % 9 == 0, F.concat(text, F.lit("?"))).otherwise(text)).withColumn("more", F.lit(1))
    fine, broken = as_declared(found, SCHEMAS["documents"])
    rows = fine.select("doc_id", F.col("n_chars").cast("string").alias("n_chars"), F.lit("").alias("uncast"))
    return rows.unionByName(broken.select("doc_id", "n_chars", F.array_join("uncast", ",").alias("uncast")))


@query(f"WITH {SELECTED} SELECT doc_id, 'doc' || doc_id || '-page-' || page_no AS filename, text, CAST(doc_id % 16 AS INTEGER) AS shelf FROM selected")
def split_documents_by_shelf(spark, sf):
    path = f"{shared_dir(spark)}/split-{uuid.uuid4().hex}"
    outputs = D.split_documents(selected(spark, sf), file_name(), "separate").withColumn("shelf", (F.col("doc_id") % 16).cast("int"))
    write_by_key(outputs, path, "shelf")
    return spark.read.schema(outputs.schema).parquet(path)
