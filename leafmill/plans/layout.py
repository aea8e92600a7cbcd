"""Registered queries over budgets, scripts and boxes, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions.scalars import rgb
from leafmill.operators import budget as B
from leafmill.operators import geometry as G
from leafmill.operators import text as T
from leafmill.plans.registry import query
from leafmill.sources.tables import ELEMENT_TYPES, elements, page_counts, table


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("""WITH p(level, scale, quality) AS (VALUES ('low', CAST(2.0 AS DOUBLE), CAST(0.8 AS DOUBLE)), ('medium', 1.5, 0.6), ('high', 1.0, 0.4)), s AS (SELECT doc_id, n_chars, level, CAST(ceil(n_chars * scale * scale * (CAST(0.1 AS DOUBLE) + quality)) AS BIGINT) AS bytes FROM documents, p)
SELECT doc_id, level, bytes, CASE WHEN n_chars > 0 THEN 1 - bytes / n_chars END AS saving FROM s""")
def size_presets(spark, sf):
    return B.size_presets(docs(spark, sf))


TARGET = 2_000


@query("""WITH t(tier, scale) AS (VALUES (1, CAST(1.5 AS DOUBLE)), (2, 1.1), (3, 0.85), (4, 0.65), (5, 0.5)), g AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS k),
d AS (SELECT doc_id, n_chars, (len(string_split(coalesce(text, ''), chr(10))) + 9) // 10 AS pages FROM documents),
r AS (SELECT doc_id, pages, greatest(1, 2000 - 300 * pages) AS budget, tier, k, CAST(0.05 AS DOUBLE) + k * CAST(0.87 AS DOUBLE) / 64 AS quality, CAST(ceil(n_chars * scale * scale * (CAST(0.1 AS DOUBLE) + (CAST(0.05 AS DOUBLE) + k * CAST(0.87 AS DOUBLE) / 64))) AS BIGINT) AS bytes FROM d, t, g WHERE n_chars > 2000),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier, k DESC) AS n FROM r WHERE bytes <= budget),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY bytes, tier, k) AS n FROM r WHERE doc_id NOT IN (SELECT doc_id FROM f)),
b AS (SELECT doc_id, tier, quality, bytes + 300 * pages AS bytes FROM f WHERE n = 1 UNION ALL SELECT doc_id, tier, quality, bytes + 300 * pages FROM u WHERE n = 1)
SELECT doc_id, tier, quality, bytes, bytes <= 2000 AS met_target FROM b UNION ALL SELECT doc_id, 0, NULL, n_chars, true FROM d WHERE n_chars <= 2000""")
def fit_to_budget(spark, sf):
    return B.fit_own(page_counts(docs(spark, sf), more=["n_chars"]), TARGET)


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(regexp_extract(text, '[A-Za-z\x{0591}-\x{07FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]'), '^[A-Za-z]') THEN 'ltr' WHEN regexp_extract(text, '[A-Za-z\x{0591}-\x{07FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]') <> '' THEN 'rtl' WHEN regexp_matches(text, '^[0-9\s/\-.:,()+]+$') THEN 'ltr' WHEN doc_id % 2 = 0 THEN 'rtl' ELSE 'ltr' END AS dir
FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text ELSE regexp_replace(text, '[A-Za-z]', '', 'g') END AS text FROM documents)""")
def text_direction(spark, sf):
    text = F.when(F.col("doc_id") % 7 == 0, F.col("text")).otherwise(F.regexp_replace("text", "[A-Za-z]", ""))
    return T.text_direction(docs(spark, sf).select("doc_id", text.alias("text"), F.when(F.col("doc_id") % 2 == 0, "rtl").alias("stored")), "stored")


FONTS = [*[(f, True, f in ("Gveret Levin", "Playpen Sans Hebrew")) for f in T.HEBREW_FONTS], ("Caveat", False, True), ("Inter", False, False)]


@query("""SELECT doc_id AS id, requested, CASE WHEN NOT coalesce(regexp_matches(text, '[\\x{0590}-\\x{05FF}\\x{FB1D}-\\x{FB4F}]'), false) THEN coalesce(nullif(requested, ''), 'Arimo') WHEN requested = 'Caveat' THEN 'Gveret Levin' WHEN requested = 'Heebo' THEN 'Heebo' ELSE 'Arimo' END AS resolved
FROM (SELECT doc_id, ['Caveat', 'Inter', 'Heebo', '', 'Unknown'][doc_id % 5 + 1] AS requested, CASE WHEN doc_id % 3 = 0 THEN 'א' || text ELSE text END AS text FROM documents)""")
def font_fallback(spark, sf):
    fonts = spark.createDataFrame(FONTS, "family string, hebrew boolean, handwriting boolean")
    requested = F.element_at(F.array(*map(F.lit, ["Caveat", "Inter", "Heebo", "", "Unknown"])), (F.col("doc_id") % 5 + 1).cast("int"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("א"), "text")).otherwise(F.col("text"))
    return T.font_fallback(docs(spark, sf).select(F.col("doc_id").alias("id"), requested.alias("requested"), text.alias("text")), fonts)


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,\n"


@query("""SELECT lang, ch, count(*) AS docs FROM (SELECT DISTINCT doc_id, lang, ch FROM (SELECT doc_id, lang, unnest(string_split(text, '')) AS ch FROM documents)) WHERE ch <> '' AND NOT (lang IN ('en', 'fr', 'de', 'es') AND contains('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,' || chr(10), ch)) GROUP BY lang, ch""")
def charset_gaps(spark, sf):
    sets = spark.createDataFrame([(lang, ch) for lang in ("en", "fr", "de", "es") for ch in LETTERS], "lang string, ch string")
    return T.charset_gaps(docs(spark, sf), sets)


@query("""WITH f AS (SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS text, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 70 END AS cells, o_orderkey % 2 = 0 AS rtl FROM orders),
c AS (SELECT *, CASE WHEN coalesce(cells, 0) <> 0 THEN greatest(1, least(60, cells)) ELSE greatest(1, length(text)) END AS n FROM f), i AS (SELECT *, CAST(unnest(range(n)) AS INTEGER) AS idx FROM c)
SELECT id, idx, substr(text, idx + 1, 1) AS ch, CASE WHEN rtl THEN 1 - (idx + CAST(0.5 AS DOUBLE)) / n ELSE (idx + CAST(0.5 AS DOUBLE)) / n END AS center FROM i""")
def cell_layout(spark, sf):
    orders = table(spark, sf, "orders")
    return T.cell_layout(orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("text"), F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_custkey") % 70).cast("double")).alias("cells"), (F.col("o_orderkey") % 2 == 0).alias("rtl")))


KINDS = ", ".join(f"'{k}'" for k in ELEMENT_TYPES)
ELEMENTS = f"""elements AS (SELECT l_orderkey AS doc, l_linenumber - 1 AS page_index, 'el-' || l_orderkey || '-' || l_linenumber AS id, [{KINDS}][l_linenumber % 9 + 1] AS type, CAST(l_partkey % 101 AS DOUBLE) AS "left", CAST(l_suppkey * 7 % 101 AS DOUBLE) AS top, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS width, l_tax * 100 + 1 AS height FROM lineitem)"""


def placed(spark, sf):
    return elements(table(spark, sf, "lineitem"))


@query(f"""WITH {ELEMENTS} SELECT id, doc, page_index, CASE WHEN type = 'line' THEN 'x1' WHEN type <> 'text' AND width IS NULL THEN 'width' END AS rule FROM elements""")
def validate_elements(spark, sf):
    fine, broken = G.validate_elements(placed(spark, sf))
    return fine.select("id", "doc", "page_index", F.lit(None).cast("string").alias("rule")).unionByName(broken.select("id", "doc", "page_index", "rule"))


@query(f"""WITH {ELEMENTS}, s AS (SELECT *, CASE WHEN doc % 2 = 0 THEN CAST(595 AS DOUBLE) ELSE 612 END AS pw, CASE WHEN doc % 2 = 0 THEN CAST(842 AS DOUBLE) ELSE 792 END AS ph FROM elements)
SELECT doc, id, page_index, "left" / 100 * pw AS x, ph - top / 100 * ph AS y, width / 100 * pw AS w, height / 100 * ph AS h FROM s""")
def to_points(spark, sf):
    pages = placed(spark, sf).where("doc % 2 = 0").select("doc", "page_index").distinct().select("doc", "page_index", F.lit(595.0).alias("page_w"), F.lit(842.0).alias("page_h"))
    return G.to_points(placed(spark, sf), pages).select("doc", "id", "page_index", "x", "y", "w", "h")


HANDLES = ["move", "right", "left", "top", "bottom", "top-left", "bottom-right", "bottom-left", "top-right"]


@query(f"""WITH {ELEMENTS}, p AS (SELECT *, CASE WHEN doc % 4 > 0 THEN ['move', 'right', 'left', 'top', 'bottom', 'top-left', 'bottom-right', 'bottom-left', 'top-right'][doc % 9 + 1] ELSE '' END AS handle, CAST(doc % 61 - 30 AS DOUBLE) AS dx, CAST(doc % 47 - 23 AS DOUBLE) AS dy FROM elements WHERE width IS NOT NULL),
s AS (SELECT *, CASE WHEN contains(handle, 'right') THEN greatest(1, least(90, 100 - "left", width + dx)) WHEN contains(handle, 'left') THEN greatest(1, least(90, "left" + width, width - dx)) ELSE width END AS nw,
CASE WHEN contains(handle, 'bottom') THEN greatest(1, least(90, 100 - top, height + dy)) WHEN contains(handle, 'top') THEN greatest(1, least(90, top + height, height - dy)) ELSE height END AS nh FROM p)
SELECT id, CASE WHEN handle = 'move' THEN "left" + greatest(-"left", least(100 - width - "left", dx)) WHEN contains(handle, 'left') THEN "left" - (nw - width) ELSE "left" END AS "left",
CASE WHEN handle = 'move' THEN top + greatest(-top, least(100 - height - top, dy)) WHEN contains(handle, 'top') THEN top - (nh - height) ELSE top END AS top, nw AS width, nh AS height FROM s""")
def clamp_elements(spark, sf):
    boxes = placed(spark, sf).where("width is not null")
    handle = F.element_at(F.array(*map(F.lit, HANDLES)), (F.col("doc") % 9 + 1).cast("int"))
    patches = boxes.where("doc % 4 > 0").select("id", handle.alias("handle"), (F.col("doc") % 61 - 30).cast("double").alias("dx"), (F.col("doc") % 47 - 23).cast("double").alias("dy")).distinct()
    return G.clamp_elements(boxes, patches).select("id", "left", "top", "width", "height")


@query(f"""WITH {ELEMENTS}, p AS (SELECT *, CASE WHEN doc % 3 > 0 THEN CAST(doc % 61 - 30 AS DOUBLE) END AS dw, CAST(0.5 AS DOUBLE) + page_index AS ratio, CASE WHEN doc % 2 = 0 THEN CAST(595 AS DOUBLE) ELSE 612 END AS pw, CASE WHEN doc % 2 = 0 THEN CAST(842 AS DOUBLE) ELSE 792 END AS ph FROM elements),
s AS (SELECT *, dw IS NOT NULL AND width IS NOT NULL AS patched, greatest(CAST(2 AS DOUBLE), least(CAST(60 AS DOUBLE), width + dw)) AS nw FROM p), t AS (SELECT *, nw * ratio * (pw / ph) AS nh FROM s)
SELECT id, CASE WHEN patched THEN nw ELSE width END AS width, CASE WHEN patched THEN nh ELSE height END AS height,
CASE WHEN patched THEN greatest(0, least(100 - nw, "left" + (width - nw) / 2)) ELSE "left" END AS "left", CASE WHEN patched THEN greatest(0, least(100 - nh, top + (height - nh) / 2)) ELSE top END AS top FROM t""")
def resize_centred(spark, sf):
    even = F.col("doc") % 2 == 0
    # an unknown page size is the default one, so only even documents name theirs
    patches = placed(spark, sf).where("doc % 3 > 0").select(
        "id", (F.col("doc") % 61 - 30).cast("double").alias("dw"), F.lit(2.0).alias("least"), (F.lit(0.5) + F.col("page_index")).alias("ratio"), F.when(even, 595.0).alias("page_w"), F.when(even, 842.0).alias("page_h")
    ).distinct()
    return G.resize_centred(placed(spark, sf), patches).select("id", "left", "top", "width", "height")


@query(f"""WITH {ELEMENTS} SELECT doc, min("left") AS "left", min(top) AS top, max("left" + width) - min("left") AS width, max(top + height) - min(top) AS height FROM elements GROUP BY doc""")
def object_bounds(spark, sf):
    return G.object_bounds(placed(spark, sf), ["doc"])


@query(f"""WITH {ELEMENTS}, b AS (SELECT *, CAST(0.5 AS DOUBLE) + page_index AS a, CAST(doc % 3 - 1 AS DOUBLE) AS s FROM elements WHERE width IS NOT NULL),
c AS (SELECT *, a * "left" + -s * top + 10 AS x1, a * ("left" + width) + -s * top + 10 AS x2, a * "left" + -s * (top + height) + 10 AS x3, a * ("left" + width) + -s * (top + height) + 10 AS x4,
  s * "left" + a * top - 5 AS y1, s * ("left" + width) + a * top - 5 AS y2, s * "left" + a * (top + height) - 5 AS y3, s * ("left" + width) + a * (top + height) - 5 AS y4 FROM b)
SELECT id, least(x1, x2, x3, x4) AS min_x, least(y1, y2, y3, y4) AS min_y, greatest(x1, x2, x3, x4) AS max_x, greatest(y1, y2, y3, y4) AS max_y, width * CAST(1.5 AS DOUBLE) * (CAST(612 AS DOUBLE) / 792) AS height_pct FROM c""")
def transform_boxes(spark, sf):
    a, s = F.lit(0.5) + F.col("page_index"), (F.col("doc") % 3 - 1).cast("double")
    x, y = F.col("left"), F.col("top")
    ends = G.affine_box([a, s, -s, a, F.lit(10.0), F.lit(-5.0)], x, y, x + F.col("width"), y + F.col("height"))
    high = G.height_percent(F.col("width"), F.lit(1.5), F.lit(G.PAGE_WIDTH), F.lit(G.PAGE_HEIGHT))
    return placed(spark, sf).where("width is not null").select("id", *[e.alias(n) for e, n in zip(ends, ("min_x", "min_y", "max_x", "max_y"), strict=True)], high.alias("height_pct"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN 'red' WHEN l_partkey % 5 = 1 THEN '' ELSE '#' || printf('%02x%02X%02x', l_partkey % 256, l_suppkey % 256, l_linenumber * 30) END AS colour FROM lineitem),
h AS (SELECT *, CASE WHEN starts_with(colour, '#') THEN colour ELSE '#000000' END AS hex FROM c)
SELECT l_orderkey, l_linenumber, CAST('0x' || substr(hex, 2, 2) AS INTEGER) / CAST(255 AS DOUBLE) AS r, CAST('0x' || substr(hex, 4, 2) AS INTEGER) / CAST(255 AS DOUBLE) AS g, CAST('0x' || substr(hex, 6, 2) AS INTEGER) / CAST(255 AS DOUBLE) AS b FROM h""")
def element_colours(spark, sf):
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    colour = F.when(part % 5 == 0, "red").when(part % 5 == 1, "").otherwise(F.concat(F.lit("#"), F.lower(two(part % 256)), two(supplier % 256), two(F.col("l_linenumber") * 30)))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", rgb(colour).alias("c")).select("l_orderkey", "l_linenumber", "c.*")


FAMILIES = ["Arimo", "Heebo", "Pacifico", "Unknown"]


@query("""SELECT doc_id, family, CASE WHEN family = 'Unknown' THEN CAST(PADDING AS DOUBLE) ELSE greatest(CAST(PADDING AS DOUBLE), greatest(0, (CASE family WHEN 'Arimo' THEN CAST(0.905 AS DOUBLE) + CAST(0.212 AS DOUBLE) WHEN 'Heebo' THEN CAST(1.048 AS DOUBLE) + CAST(0.421 AS DOUBLE) ELSE CAST(1.303 AS DOUBLE) + CAST(0.453 AS DOUBLE) END - CAST(LINE AS DOUBLE)) / 2) + CAST(0.06 AS DOUBLE)) END AS padding
FROM (SELECT doc_id, ['Arimo', 'Heebo', 'Pacifico', 'Unknown'][doc_id % 4 + 1] AS family FROM documents)""".replace("PADDING", str(T.LEAST_PADDING)).replace("LINE", str(T.LINE_HEIGHT)))
def text_padding(spark, sf):
    texts = docs(spark, sf).select("doc_id", F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("doc_id") % 4 + 1).cast("int")).alias("family"))
    return T.box_padding(texts, spark.createDataFrame(T.METRICS, "family string, ascent double, descent double"))
