"""Objects in pages, sensitive spans, and their removal or masking. Spans are half-open and count code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.arrays import bound, pieces_joined, running

#: Detectors: pattern by type of redaction. Patterns keep to what both Java's and RE2's expressions know.
RULES = {
    "blackout": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "whiteout": r"[0-9]{16}",
    "blur": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "delete": r"This work is licensed[^\n]*",
}
#: Self-contained objects of an HTML page.
OBJECTS = {
    "heading": r"<h[1-6][^>]*>[^<]*</h[1-6]>",
    "paragraph": r"<p>[^<]*</p>",
    "link": r"<a [^>]*>[^<]*</a>",
    "script": r"<script[^>]*>[^<]*</script>",
    "style": r"<style[^>]*>[^<]*</style>",
    "comment": r"<!--[^>]*-->",
}


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of a pattern's matches.

    The matches and the pieces between them come from one expression; running lengths give the offsets.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    size = lambda x: F.char_length(x).cast("long")
    placed = lambda values, ends: F.transform(values, lambda v, i: F.struct((F.get(ends, i) - size(v)).alias("start"), F.get(ends, i).alias("end"), v.alias("value")))
    ends = lambda values: running(F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(values)).alias("gap"), values.alias("value")), lambda x: size(x["gap"]) + size(x["value"])), lambda a, x: a + x)
    return bound(found, lambda values: bound(ends(values), lambda e: placed(values, e)))


SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


def spans_in(text: Column, rules: dict[str, str] = RULES) -> Column:
    """array<struct<type,start,end,value>> of every match of every rule in a text."""
    text = F.coalesce(text, F.lit(""))
    tagged = lambda kind, pattern: F.transform(F.when(text.rlike(pattern), matches(text, pattern)).otherwise(F.array().cast(SPANS)), lambda m: F.struct(F.lit(kind).alias("type"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    return F.concat(*[tagged(kind, pattern) for kind, pattern in rules.items()])


def detect_spans(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """doc_id, type, start, end, value of every match of every rule."""
    return docs.select("doc_id", F.explode(spans_in(F.col("text"), rules)).alias("s")).select("doc_id", "s.type", "s.start", "s.end", "s.value")


def page_objects(pages: DataFrame) -> DataFrame:
    """page_id, id, kind, start, end, preview, left_pct, width_pct; an unreadable (null) page has none."""
    html = F.col("html")
    tagged = lambda kind, pattern: F.transform(matches(html, pattern), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), F.substring(m["value"], 1, 40).alias("preview")))
    found = F.array_sort(F.concat(*[tagged(kind, pattern) for kind, pattern in OBJECTS.items()]))
    rows = pages.where("html is not null").select("page_id", F.length("html").alias("size"), F.posexplode(found).alias("n", "o"))
    share = lambda x: x * 100.0 / F.col("size")
    return rows.select("page_id", F.concat(F.lit("obj-"), F.col("page_id").cast("string"), F.lit("-"), (F.col("n") + 1).cast("string")).alias("id"), "o.kind", "o.start", "o.end", "o.preview", share(F.col("o.start")).alias("left_pct"), share(F.col("o.end") - F.col("o.start")).alias("width_pct"))


def merge_spans(spans: DataFrame, keys: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The union of overlapping or touching spans of a document."""
    own = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select(*keys, "start", "end").withColumn("fresh", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    islands = marked.withColumn("island", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _with_spans(docs: DataFrame, spans: DataFrame, *more: str) -> DataFrame:
    own = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", *more))).alias("spans"))
    return docs.join(own, "doc_id", "left")


def splice_out(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the merged spans cut out, one line break left for each cut; others are unchanged."""
    rows = _with_spans(docs, merge_spans(spans))
    return rows.withColumn("text", F.when(F.col("spans").isNotNull(), pieces_joined(F.col("text"), F.col("spans"), lambda s, old: F.lit("\n"))).otherwise(F.col("text"))).drop("spans")


def mask(kind: Column, value: Column, salt: str) -> Column:
    """A solid run of the same length for blackout and whiteout, a salted token for blur."""
    solid = F.when(kind == "whiteout", " ").otherwise("█")
    token = F.concat(F.lit("["), F.substring(F.sha2(F.concat(F.lit(salt), value).cast("binary"), 256), 1, 8), F.lit("]"))
    return F.when(kind == "blur", token).otherwise(F.repeat(solid, F.length(value)))


def redact_text(docs: DataFrame, redactions: DataFrame, salt: str = "leaf") -> DataFrame:
    """docs with their redactions masked, and touched; documents without any pass through unchanged.

    Of overlapping redactions the one that starts first (then ends last) masks the common part.
    """
    own = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "type")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    apart = redactions.where("type <> 'delete'").withColumn("start", F.greatest("start", F.coalesce(reach, F.lit(0)))).where("end > start")
    rows = _with_spans(docs, apart, "type")
    masked = pieces_joined(F.col("text"), F.col("spans"), lambda s, old: mask(s["type"], old, salt))
    return rows.withColumn("text", F.when(F.col("spans").isNotNull(), masked).otherwise(F.col("text"))).withColumn("touched", F.col("spans").isNotNull()).drop("spans")


def merged_in(spans: Column) -> Column:
    """The union of overlapping or touching spans of an array, in order."""

    def islands(own: Column, reach: Column) -> Column:
        # a span that starts beyond all before it begins an island, which ends with what is reached before the next one
        first = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | (F.get(own, i)["start"] > F.get(reach, i - 1)))
        last = lambda starts, k: F.coalesce(F.get(starts, k + 1), F.size(own)) - 1
        return bound(first, lambda starts: F.transform(starts, lambda i, k: F.struct(F.get(own, i)["start"].alias("start"), F.get(reach, last(starts, k)).alias("end"))))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    joined = lambda own: bound(running(F.transform(own, lambda s: s["end"]), F.greatest), lambda reach: islands(own, reach))
    return bound(ordered, lambda own: F.when(F.size(own) > 0, joined(own)).otherwise(own))


def apart_in(spans: Column) -> Column:
    """Spans of an array that no longer overlap: the one that starts first (then ends last) keeps the common part."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("far"), s["type"].alias("type"))))

    def kept(own: Column, reach: Column) -> Column:
        start = lambda s, i: F.when(i > 0, F.greatest(s["start"], F.get(reach, i - 1))).otherwise(s["start"])
        return F.filter(F.transform(own, lambda s, i: F.struct(start(s, i).alias("start"), (-s["far"]).alias("end"), s["type"].alias("type"))), lambda s: s["end"] > s["start"])

    return bound(ordered, lambda own: bound(running(F.transform(own, lambda s: -s["far"]), F.greatest), lambda reach: kept(own, reach)))


def splice_own(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """splice_out() of the texts' own matches of the rules, within the row: nothing is shuffled."""
    rows = docs.withColumn("_spans", merged_in(spans_in(F.col("text"), rules)))
    return rows.withColumn("text", F.when(F.size("_spans") > 0, pieces_joined(F.col("text"), F.col("_spans"), lambda s, old: F.lit("\n"))).otherwise(F.col("text"))).drop("_spans")


def redact_own(docs: DataFrame, rules: dict[str, str] = RULES, salt: str = "leaf") -> DataFrame:
    """redact_text() of the texts' own matches of the rules, within the row: nothing is shuffled."""
    masked = {k: v for k, v in rules.items() if k != "delete"}
    if not masked:
        return docs.withColumn("touched", F.lit(False))
    rows = docs.withColumn("_spans", apart_in(spans_in(F.col("text"), masked))).withColumn("touched", F.size("_spans") > 0)
    return rows.withColumn("text", F.when(F.col("touched"), pieces_joined(F.col("text"), F.col("_spans"), lambda s, old: mask(s["type"], old, salt))).otherwise(F.col("text"))).drop("_spans")


def apply_page_edits(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Deletions first, then redactions, whose spans are found anew in what the deletions left; all within the row."""
    cuts = {k: v for k, v in rules.items() if k == "delete"}
    return redact_own(splice_own(docs, cuts) if cuts else docs, rules)


def redaction_summary(docs: DataFrame, redactions: DataFrame) -> DataFrame:
    """doc_id, boxes by type, touched: whether the document is rewritten or copied."""
    counted = redactions.groupBy("doc_id").pivot("type", list(RULES)).agg(F.count(F.lit(1)))
    rows = docs.select("doc_id").join(counted, "doc_id", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select("doc_id", *[number(F.col(k)).alias(k) for k in RULES], (sum((number(F.col(k)) for k in RULES), F.lit(0)) > 0).alias("touched"))


def redaction_audit(redacted: DataFrame, redactions: DataFrame) -> DataFrame:
    """doc_id, removed, residual: removed values, and those still found in the redacted text."""
    values = redactions.select("doc_id", "value").distinct()
    rows = values.join(redacted.select("doc_id", "text"), "doc_id")
    return rows.groupBy("doc_id").agg(F.count("*").alias("removed"), F.count_if(F.contains("text", "value")).alias("residual"))


def edit_audit(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """redaction_audit() of apply_page_edits() by the same rules, in one pass over the documents."""
    values = F.array_distinct(F.transform(spans_in(F.col("text"), rules), lambda s: s["value"]))
    edited = apply_page_edits(docs.select("doc_id", "text", values.alias("_values")), rules).where(F.size("_values") > 0)
    return edited.select("doc_id", F.size("_values").cast("long").alias("removed"), F.size(F.filter("_values", lambda v: F.contains("text", v))).cast("long").alias("residual"))


def toggle_marks(clicks: DataFrame, objects: DataFrame) -> DataFrame:
    """object_id, marked of every object: an odd number of clicks marks it; clicks on other objects are ignored."""
    odd = clicks.groupBy("object_id").agg((F.count("*") % 2 == 1).alias("odd")).where("odd").select("object_id")
    ids = objects.select("object_id").distinct()
    return ids.join(odd, "object_id", "left_semi").withColumn("marked", F.lit(True)).unionByName(ids.join(odd, "object_id", "left_anti").withColumn("marked", F.lit(False)))
