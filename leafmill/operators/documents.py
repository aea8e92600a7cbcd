"""Collections, pages and selections of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.scalars import base_name, js_round, name_date, natural_key, size_label
from leafmill.operators.ranks import with_rank, with_running_sum
from leafmill.sources.tables import PAGE_LINES, n_pages, page_counts, page_texts

#: Pages of one merged record at most: a larger collection goes on in the next part.
MERGED_PAGES = 1_000


def intake_split(df: DataFrame, type_col: str, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of an allowed type, and the rest; a null type is rejected."""
    fine = F.coalesce(F.col(type_col).isin(allowed), F.lit(False))
    return df.where(fine), df.where(~fine)


def collection_summary(docs: DataFrame) -> DataFrame:
    sized = page_counts(docs.select("source", "doc_id", "text")).groupBy("source").agg(F.count("*").alias("docs"), F.sum("pages").cast("long").alias("pages"))
    sizes = docs.groupBy("source").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes"))
    label = F.concat(F.col("pages").cast("string"), F.when(F.col("pages") == 1, " page").otherwise(" pages"), F.lit(" · "), size_label(F.col("bytes")))
    return sized.join(sizes, sized.source.eqNullSafe(sizes.source)).select(sized.source, "docs", "pages", "bytes", label.alias("label"))


def asset_manifest(pages: DataFrame, own: str = "/manifest.json") -> DataFrame:
    """url, sha256 of the content; of a repeated URL the smallest hash; the manifest itself is left out."""
    return pages.where(F.col("url") != own).groupBy("url").agg(F.min(F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)).alias("sha256"))


def build_id(manifest: DataFrame) -> DataFrame:
    """Twelve hexadecimal digits over the ordered manifest, by a tree of ordered buckets: 16^6 of rows, 16^3 of those, one of these."""
    row = F.concat("url", F.lit(" "), "sha256")
    rows = manifest.groupBy(F.substring(F.sha2(F.col("url").cast("binary"), 256), 1, 6).alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n").cast("binary"), 256).alias("h"))
    ordered = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda b: b["h"]), "").cast("binary"), 256)
    buckets = rows.groupBy(F.substring("bucket", 1, 3).alias("upper")).agg(ordered.alias("h")).withColumnRenamed("upper", "bucket")
    return buckets.agg(F.substring(ordered, 1, 12).alias("build_id"))


def sitemap_export(home: DataFrame, tools: DataFrame, pages: DataFrame) -> DataFrame:
    """loc, changefreq, priority and the XML record of each; a URL that several inputs hold comes once, the highest priority first."""
    best = home.unionByName(tools).unionByName(pages).groupBy("loc").agg(F.max(F.struct("priority", "changefreq")).alias("best"))
    xml = F.concat(F.lit("<url><loc>"), "loc", F.lit("</loc><changefreq>"), F.col("best.changefreq"), F.lit("</changefreq><priority>"), F.col("best.priority"), F.lit("</priority></url>"))
    return best.select("loc", F.col("best.changefreq").alias("changefreq"), F.col("best.priority").alias("priority"), xml.alias("xml"))


#: URLs of a sitemap file at most, as the protocol allows.
SITEMAP_URLS = 50_000


def sitemap_files(sitemap: DataFrame, most: int = SITEMAP_URLS) -> DataFrame:
    """shard, urls, document: whole sitemap files, of at most `most` records each in the order of their URLs."""
    rows = with_rank(sitemap.select("loc", "xml"), [F.col("loc")]).groupBy(F.floor((F.col("rank") - 1) / most).alias("shard")).agg(F.array_sort(F.collect_list(F.struct("rank", "xml"))).alias("all"))
    head, foot = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n', "\n</urlset>\n"
    return rows.select("shard", F.size("all").cast("long").alias("urls"), F.concat(F.lit(head), F.array_join("all.xml", "\n"), F.lit(foot)).alias("document"))


def write_sitemap(sitemap: DataFrame, path: str, most: int = SITEMAP_URLS) -> None:
    """Each document of sitemap_files() in a file of its own."""
    sitemap_files(sitemap, most).select("document").write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def paginate(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """pages with running_no: the number across the documents of a collection. A collection of any size is dealt over many tasks.

    Pages made elsewhere find their document by (source, doc_id), nulls included, so no document may stand twice; paginate_own()
    takes any rows.
    """
    starts = with_running_sum(page_counts(docs), ["source"], ["doc_id"], "pages", "start").alias("d")
    own = F.col("p.source").eqNullSafe(F.col("d.source")) & F.col("p.doc_id").eqNullSafe(F.col("d.doc_id"))
    return pages.alias("p").join(starts, own).select("p.source", "p.doc_id", "page_no", (F.col("start") + F.col("page_no")).alias("running_no"), "p.text")


def paginate_own(docs: DataFrame, lines: int = PAGE_LINES) -> DataFrame:
    """source, doc_id, page_no, running_no, text: the pages of docs, numbered across the rows of each collection.

    Every row counts once, rows with a null source or id (these come first) and repeated ones (by the md5 of their text) too.
    A row learns where it starts before its pages are made, so whole texts are dealt once by ranges and no page is joined.
    """
    rows = docs.select("source", "doc_id", "text", F.md5(F.col("text").cast("binary")).alias("_mark"), n_pages(F.col("text"), lines).cast("long").alias("_pages"))
    starts = with_running_sum(rows, ["source"], ["doc_id", "_mark"], "_pages", "start", settled=True)
    pages = starts.select("source", "doc_id", "start", F.posexplode(page_texts(F.col("text"), lines)).alias("n", "text"))
    return pages.select("source", "doc_id", (F.col("n") + 1).alias("page_no"), (F.col("start") + F.col("n") + 1).alias("running_no"), "text")


def merge_collection(numbered: DataFrame, label: bool = False) -> DataFrame:
    """source, part, pages, text: a collection's pages in order, at most MERGED_PAGES a part; label puts the number ahead."""
    text = F.concat(F.lit("["), F.col("running_no").cast("string"), F.lit("]\n"), "text") if label else F.col("text")
    part = F.floor((F.col("running_no") - 1) / MERGED_PAGES)
    rows = numbered.groupBy("source", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("running_no", text.alias("t")))).alias("all"))
    return rows.select("source", "part", F.size("all").cast("long").alias("pages"), F.array_join("all.t", "\n").alias("text"))


def select_pages(pages: DataFrame, counts: DataFrame, specs: DataFrame, dialect: str = "strict") -> tuple[DataFrame, DataFrame]:
    """Pages that a printer-style selector names, and the selectors in error with the reason.

    strict: `3`, `1-3`, `8-`, `-4`; a page that does not exist is an error. clamping: `3`, `1-3`; pages that do not exist
    are dropped, and an error only when none is left. Reversed ranges are turned, blank is all, blank parts are skipped,
    commas alone are an error.
    """
    known = counts.select(F.col("doc_id").alias("_doc"), "pages").distinct()
    spec = specs.join(known, specs["doc_id"].eqNullSafe(F.col("_doc"))).drop("_doc").withColumn("trimmed", F.trim(F.coalesce("spec", F.lit(""))))
    parts = F.filter(F.transform(F.split("trimmed", ","), lambda p: F.trim(p)), lambda p: p != "")
    spec = spec.withColumn("parts", F.when(F.col("trimmed") == "", F.array(F.concat(F.lit("1-"), F.col("pages").cast("string")))).otherwise(parts))
    shape = r"^(\d*)\s*(-?)\s*(\d*)$" if dialect == "strict" else r"^(\d+)\s*(-?)\s*(\d*)$"

    def span(p: Column) -> Column:
        a, dash, b = (F.regexp_extract(p, shape, i) for i in (1, 2, 3))
        digits = lambda x: F.regexp_replace(x, r"^0+(?=[0-9])", "")
        number = lambda x: F.when(F.length(digits(x)) > 18, F.lit(10**18)).otherwise(digits(x).try_cast("long"))  # noqa: E731  beyond any page
        low = F.when(a != "", number(a)).otherwise(F.lit(1).cast("long"))
        high = F.when(b != "", number(b)).when(dash == "", number(a)).otherwise(F.col("pages").cast("long") if dialect == "strict" else F.lit(None).cast("long"))
        open_end = (dash == "") & (b != "") | (a == "") & (b == "")
        return F.struct(F.when(p.rlike(shape) & ~open_end, F.least(low, high)).alias("lo"), F.when(p.rlike(shape) & ~open_end & high.isNotNull(), F.greatest(low, high)).alias("hi"), p.alias("part"))

    spec = spec.withColumn("spans", F.transform("parts", span))
    wrong = lambda s: s["hi"].isNull()
    outside = lambda s: (s["lo"] < 1) | (s["hi"] > F.col("pages"))
    gone = F.forall("spans", lambda s: (s["hi"] < 1) | (s["lo"] > F.col("pages")))
    reason = F.when(F.size("parts") == 0, "empty").when(F.exists("spans", wrong), "invalid")
    reason = reason.when(F.exists("spans", outside), "out of range") if dialect == "strict" else reason.when(gone, "out of range")
    spec = spec.withColumn("reason", reason)
    # a document's spans stay together, so no page is met twice and no text is compared
    spans = spec.where(F.col("reason").isNull()).groupBy(F.col("doc_id").alias("_doc")).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    chosen = pages.join(spans, pages["doc_id"].eqNullSafe(F.col("_doc"))).where(F.exists("spans", lambda s: F.col("page_no").between(s["lo"], s["hi"]))).select("doc_id", "page_no", "text")
    return chosen, spec.where(F.col("reason").isNotNull()).select("doc_id", "spec", "reason")


def page_ranges(pages: DataFrame) -> DataFrame:
    """doc_id, range_text such as `1-3, 5` of distinct page numbers."""
    island = F.col("page_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no"))
    runs = pages.select("doc_id", "page_no").distinct().withColumn("island", island).groupBy("doc_id", "island").agg(F.min("page_no").alias("lo"), F.max("page_no").alias("hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string")))
    return runs.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", text.alias("t")))), lambda r: r["t"]), ", ").alias("range_text"))


def split_documents(selected: DataFrame, name: Column, mode: str) -> DataFrame:
    """doc_id, filename, text: one output a document (`combined`) or one a page (`separate`)."""
    if mode == "separate":
        return selected.select("doc_id", F.concat(base_name(name, "page"), F.lit("-page-"), F.col("page_no").cast("string")).alias("filename"), "text")
    rows = selected.withColumn("_name", base_name(name, "split")).groupBy("doc_id", "_name").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("all"))
    return rows.select("doc_id", F.concat("_name", F.lit("-extracted")).alias("filename"), F.array_join("all.text", "\n").alias("text"))


def edit_pages(pages: DataFrame, order: DataFrame, removed: DataFrame, rotations: DataFrame) -> DataFrame:
    """doc_id, out_no, page_no, angle, text after removing, ordering, turning (on top of the page's own angle) and numbering."""
    kept = pages.join(removed, ["doc_id", "page_no"], "left_anti").join(order, ["doc_id", "page_no"]).join(rotations, ["doc_id", "page_no"], "left")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "page_no"))
    return kept.select("doc_id", number.alias("out_no"), "page_no", ((F.col("angle") + F.coalesce("delta", F.lit(0))) % 360).alias("angle"), "text")


def invert_selection(pages: DataFrame, selected: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page_no").join(selected.select("doc_id", "page_no"), ["doc_id", "page_no"], "left_anti")


def stack_layout(boxes: DataFrame) -> DataFrame:
    """Where each page lies when a document's pages are stacked: centred, below those before."""
    doc = Window.partitionBy("doc_id")
    wide = F.max("w").over(doc)
    above = F.coalesce(F.sum("h").over(doc.orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return boxes.select("doc_id", "page_no", js_round((wide - F.col("w")) / 2).alias("x"), above.alias("y"), wide.alias("canvas_w"), F.sum("h").over(doc).alias("canvas_h"))


def job_progress(units: DataFrame) -> DataFrame:
    """job, phase, seq, fraction: with two phases the first ends at 0.4; with one it ends at 1."""
    own = Window.partitionBy("job", "phase")
    done = F.row_number().over(own.orderBy("seq")) / F.count("*").over(own)
    both = F.min("phase").over(Window.partitionBy("job")) < F.max("phase").over(Window.partitionBy("job"))
    return units.select("job", "phase", "seq", F.when(~both, done).when(F.col("phase") == 1, done * 0.4).otherwise(0.4 + done * 0.6).alias("fraction"))


def migrate_records(df: DataFrame) -> DataFrame:
    """type from type, else the old style, else blackout; mark from mark, else its old alias; empty counts as missing."""
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
    moved = df.withColumn("type", F.coalesce(first("type", "style"), F.lit("blackout"))).withColumn("mark", first("mark", "symbol_type"))
    return moved.drop("style", "symbol_type")


def sort_natural(df: DataFrame, name: str, tie: str, descending: bool = False) -> DataFrame:
    return with_rank(df.withColumn("_key", natural_key(F.col(name))), [F.col("_key"), F.col(tie)], descending=descending).drop("_key")


def sort_by_date(df: DataFrame, name: str, created: str, modified: str, tie: str, descending: bool = False) -> DataFrame:
    """df with sort_ts (the name's date, else created, else modified) and the rank by it."""
    found = df.withColumn("sort_ts", F.coalesce(name_date(F.col(name)).cast("timestamp_ntz"), F.col(created), F.col(modified)))
    return with_rank(found, [F.col("sort_ts"), F.col(tie)], descending=descending)
