"""Registered queries over a crawl, with their DuckDB counterparts.

The crawl's pages carry no policy, JSON-LD, images or links out, so the queries run over pages to which both sides add the
same markup, by SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import documents as D
from leafmill.operators import site as S
from leafmill.plans.registry import query
from leafmill.sources.tables import event_key, table

HEAD = """concat(CASE WHEN page_id % 2 = 0 THEN '<link rel="canonical" href="/c/">' ELSE '' END, CASE WHEN page_id % 3 = 0 THEN '<meta name="description" content="about"><meta property="og:title" content="t"><meta name="twitter:card" content="c">' ELSE '' END,
 CASE WHEN page_id % 4 = 0 THEN '<script type="application/ld+json">{"@type": "SoftwareApplication"}</script>' ELSE '' END, CASE WHEN page_id % 5 = 0 THEN '<script type="application/ld+json">{"@type": "FAQPage", "mainEntity": [{"name": "First?"}, {"name": "Second?"}]}</script>' ELSE '' END, CASE WHEN page_id % 7 = 0 THEN '<script type="application/ld+json">{"@type": </script>' ELSE '' END,
 CASE WHEN page_id % 3 = 1 THEN '<meta http-equiv="Content-Security-Policy" content="default-src; style-src x sha256-y">' ELSE '' END,
 '<style>@layer utilities{.btn{color:red}.pad-', CAST(page_id % 40 AS INT), '{margin:1px}}.ghost{top:0}._box_ab1_2{left:0}</style></head>')"""
BODY = """concat('<div class="btn pad-', CAST(page_id AS INT), ' mod-x &amp;raw" style="top:', CAST(page_id AS INT), 'px">x</div><section class="faq-item"><h3>First?</h3></section><img srcset="/img/', CAST(page_id AS INT), '-s.png 1x, /img/', CAST(page_id AS INT), '-l.png 2x"><img loading="lazy" src="/img/z.png"><script src="/js/', CAST(page_id AS INT), '.js"></script>',
 CASE WHEN page_id % 2 = 0 THEN '<a href="https://out.example/" target="_blank" rel="noopener noreferrer">o</a>' ELSE '<a href="https://out.example/">o</a><a href="ftp://x">f</a>' END, '<footer>')"""
MORE = f"replace(replace(html, '</head>', {HEAD}), '<footer>', {BODY})"
SITE = f"site AS (SELECT page_id, url, {MORE} AS html FROM pages)"


def site(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", F.expr(MORE).alias("html"))


RULES = " UNION ALL ".join(
    f"SELECT page_id, '{k}' AS rule, 'missing' AS detail FROM a WHERE NOT regexp_matches(html, '{p}')" for k, p in S.SEO_RULES.items()
)


@query(f"""WITH {SITE}, a AS (SELECT * FROM site WHERE NOT contains(url, '404') AND NOT contains(url, 'google')), ld AS (SELECT *, regexp_extract_all(html, '{S.JSON_LD}', 1) AS data FROM a)
SELECT page_id, 'h1' AS rule, CAST(len(regexp_extract_all(html, '<h1[ >]')) AS VARCHAR) AS detail FROM a WHERE len(regexp_extract_all(html, '<h1[ >]')) <> 1 UNION ALL {RULES} UNION ALL SELECT page_id, 'json_ld', 'invalid' FROM ld WHERE len(list_filter(data, lambda b: NOT json_valid(b))) > 0
UNION ALL SELECT page_id, 'software_application', 'missing' FROM ld WHERE len(list_filter(data, lambda b: CASE WHEN json_valid(b) THEN json_extract_string(b, '$."@type"') = 'SoftwareApplication' ELSE false END)) = 0 AND NOT contains(url, 'licenses')""")
def seo_audit(spark, sf):
    return S.seo_audit(site(spark, sf))


@query("""SELECT page_id, CAST(i AS INTEGER) AS idx, CASE WHEN page_id % 5 = 0 THEN ['First?', 'Second?'][i + 1] END AS schema_q, CASE WHEN i = 0 THEN 'First?' END AS page_q FROM pages, (VALUES (0), (1)) AS n(i) WHERE contains(html, '<footer>') AND contains(html, '</head>') AND CASE WHEN page_id % 5 = 0 THEN i = 1 ELSE i = 0 END""")
def faq_match(spark, sf):
    return S.faq_match(site(spark, sf))


INLINE = """inline AS (SELECT page_id, 'script' AS tag, unnest(list_filter(regexp_extract_all(html, '<script[^>]*>[^<]*</script>'), lambda s: NOT regexp_matches(regexp_extract(s, '^<script([^>]*)>', 1), ' src=|application/ld\\+json'))) AS t FROM site WHERE page_id % 3 = 1
UNION ALL SELECT page_id, 'style', unnest(regexp_extract_all(html, '<style[^>]*>[^<]*</style>')) FROM site WHERE page_id % 3 = 1)"""


@query(f"""WITH {SITE}, {INLINE} SELECT page_id, tag, 'sha256-' || to_base64(unhex(sha256(regexp_extract(t, '^<[^>]*>([^<]*)</', 1)))) AS hash, 'not listed' AS problem FROM inline UNION ALL SELECT page_id, 'meta', '', 'no policy' FROM site WHERE page_id % 3 <> 1""")
def csp_audit(spark, sf):
    return S.csp_audit(site(spark, sf))


@query(f"WITH {SITE} SELECT page_id, substr(tag, 1, 150) AS snippet FROM (SELECT page_id, unnest(regexp_extract_all(html, '{S.STYLED}')) AS tag FROM site)")
def inline_style_audit(spark, sf):
    return S.inline_style_audit(site(spark, sf))


WEIGHTS = f"""{SITE}, asset AS (SELECT unnest(['/js/' || page_id || '.js', '/img/' || page_id || '-s.png', '/img/' || page_id || '-l.png']) AS url, unnest([strlen(html) % 5000, strlen(html) % 5000, strlen(html) % 5000 * 4]) AS bytes FROM site),
script AS (SELECT page_id, sum(bytes) AS js FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '{S.SCRIPT_SRC}', 1)) AS url FROM site) JOIN asset USING (url) GROUP BY page_id),
image AS (SELECT page_id, unnest(range(len(tags))) AS n, unnest(tags) AS tag FROM (SELECT page_id, regexp_extract_all(html, '{S.IMAGE}') AS tags FROM site)),
candidate AS (SELECT page_id, n, unnest(range(len(urls))) AS k, regexp_replace(unnest(urls), '[?].*$', '') AS url FROM (SELECT page_id, n, CASE WHEN contains(tag, ' srcset="') THEN list_transform(string_split(regexp_extract(tag, ' srcset="([^"]*)"', 1), ','), lambda c: split_part(trim(c), ' ', 1)) ELSE [regexp_extract(tag, ' src="([^"]*)"', 1)] END AS urls FROM image WHERE NOT regexp_matches(tag, '(?i) loading="?lazy'))),
chosen AS (SELECT DISTINCT ON (page_id, n) page_id, n, url, bytes FROM candidate JOIN asset USING (url) ORDER BY page_id, n, bytes DESC, k),
picture AS (SELECT page_id, sum(bytes) AS img FROM (SELECT DISTINCT page_id, url, bytes FROM chosen) GROUP BY page_id),
w AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS doc, CAST(coalesce(js, 0) AS BIGINT) AS js, CAST(coalesce(img, 0) AS BIGINT) AS img FROM site LEFT JOIN script USING (page_id) LEFT JOIN picture USING (page_id))"""


def weights(spark, sf):
    size = F.octet_length("html") % 5000
    name = lambda kind, end: F.concat(F.lit(kind), F.col("page_id").cast("string"), F.lit(end)).alias("url")
    assets = site(spark, sf)
    assets = assets.select(name("/js/", ".js"), size.cast("long").alias("bytes")).union(assets.select(name("/img/", "-s.png"), size.cast("long"))).union(assets.select(name("/img/", "-l.png"), (size * 4).cast("long")))
    return S.page_weight(site(spark, sf), assets, page_limit=8_000)


@query(f"WITH {WEIGHTS} SELECT page_id, doc, js, img, doc + js AS total, doc + js > 8000 AS over_total, img > 15000 AS over_img FROM w")
def page_weight(spark, sf):
    return weights(spark, sf)


@query(f"""WITH {WEIGHTS} (SELECT 'total' AS budget, page_id, doc + js AS bytes, doc + js > 8000 AS over FROM w ORDER BY bytes DESC, page_id LIMIT 1) UNION ALL (SELECT 'img', page_id, img, img > 15000 FROM w ORDER BY img DESC, page_id LIMIT 1)""")
def worst_pages(spark, sf):
    return S.worst_pages(weights(spark, sf))


CSS = rf"""blocks AS (SELECT page_id, trim(unnest(regexp_extract_all(css, '{S.CSS_BLOCK}', 1))) AS block FROM (SELECT page_id, unnest(regexp_extract_all(html, '{S.STYLE_BLOCK}', 1)) AS css FROM site)),
rules AS (SELECT page_id, context, trim(split_part(t, '{{', 1)) AS prelude, trim(t) AS text FROM (SELECT page_id, CASE WHEN starts_with(block, '@') THEN trim(split_part(block, '{{', 1)) ELSE '' END AS context, unnest(regexp_extract_all(CASE WHEN starts_with(block, '@') THEN substr(block, instr(block, '{{') + 1, length(block) - instr(block, '{{') - 1) ELSE block END, '{S.CSS_RULE}', 1)) AS t FROM blocks)),
rule_classes AS (SELECT page_id, context, text, prelude, unnest(regexp_extract_all(prelude, '{S.SELECTOR_CLASS}', 1)) AS class FROM rules),
classes AS (SELECT DISTINCT page_id, class FROM (SELECT page_id, unnest(string_split_regex(replace(a, '&amp;', '&'), '\s+')) AS class FROM (SELECT page_id, unnest(regexp_extract_all(html, '{S.CLASS_ATTRIBUTE}', 1)) AS a FROM site)) WHERE class <> '')"""


@query(f"WITH {SITE}, {CSS}, d AS (SELECT context, text, count(*) AS n, CAST(strlen(text) AS BIGINT) AS bytes FROM rules GROUP BY ALL) SELECT CAST(sum(n * bytes) AS BIGINT) AS shipped, CAST(sum(bytes) AS BIGINT) AS \"distinct\", sum(n * bytes) / sum(bytes) AS factor FROM d")
def css_duplication(spark, sf):
    return S.css_duplication(S.css_rules(site(spark, sf)))


@query(f"""WITH {SITE}, {CSS}, own AS (SELECT page_id, context, text, bool_or(regexp_matches(class, '{S.HASHED}')) AS hashed, bool_or((page_id, class) IN (SELECT (page_id, class) FROM classes)) AS used FROM rule_classes GROUP BY ALL)
SELECT page_id, CASE WHEN regexp_matches(context, '^@layer\\s+utilities\\b') THEN 'utilities' ELSE 'global' END AS grp, CAST(sum(CASE WHEN used THEN 0 ELSE strlen(text) END) AS BIGINT) AS dead, CAST(sum(CASE WHEN used THEN strlen(text) ELSE 0 END) AS BIGINT) AS live FROM own WHERE NOT hashed GROUP BY 1, 2""")
def css_dead_bytes(spark, sf):
    return S.css_dead_bytes(S.css_rules(site(spark, sf)), S.page_classes(site(spark, sf)))


@query(f"WITH {SITE}, {CSS} SELECT class, min(page_id) AS page_id FROM classes WHERE class IN (SELECT class FROM rule_classes WHERE regexp_matches(context, '^@layer\\s+utilities\\b')) GROUP BY class HAVING count(*) = 1")
def single_page_classes(spark, sf):
    return S.single_page_classes(S.css_rules(site(spark, sf)), S.page_classes(site(spark, sf)))


@query(f"""WITH {SITE}, {CSS}, r AS (SELECT page_id, class, row_number() OVER (PARTITION BY class ORDER BY page_id) AS n FROM classes WHERE class <> 'ad' AND NOT starts_with(class, 'faq-') AND class NOT IN (SELECT class FROM rule_classes))
SELECT class, count(*) AS pages, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) FILTER (WHERE n <= 3) AS sample FROM r GROUP BY class""")
def dead_classes(spark, sf):
    return S.dead_classes(S.page_classes(site(spark, sf)), S.css_rules(site(spark, sf)), ["ad"], ["faq-"])


@query(f"""WITH {SITE}, {CSS} SELECT page_id AS file, class, CASE WHEN class IN (SELECT class FROM rule_classes) THEN 'global' WHEN class = 'ad' THEN 'allowed' WHEN class <> 'mod-x' THEN 'no_rule' WHEN page_id % 2 = 0 THEN 'owner_imported_but_raw' ELSE 'owner_not_imported' END AS verdict FROM classes""")
def class_resolution(spark, sf):
    uses = S.page_classes(site(spark, sf)).withColumnRenamed("page_id", "file")
    rules = S.css_rules(site(spark, sf)).select(F.explode(S.selector_classes(F.col("prelude"))).alias("class"))
    owners = spark.createDataFrame([("mod-x", "m1")], "class string, module string")
    imports = table(spark, sf, "pages").where("page_id % 2 = 0").select(F.col("page_id").alias("file"), F.lit("m1").alias("module"))
    return S.class_resolution(uses, rules, owners, imports, ["ad"])


@query("""WITH f AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]+[A-Z][a-z]+|GNU [A-Z][a-z]+')) AS token FROM documents), a(token) AS (VALUES ('GNU General'), ('GNU Lesser'))
SELECT token, 'unexpected' AS state FROM f WHERE token NOT IN (SELECT token FROM a) UNION ALL SELECT token, 'missing' FROM a WHERE token NOT IN (SELECT token FROM f)""")
def pattern_ratchet(spark, sf):
    return S.pattern_ratchet(table(spark, sf, "documents"), "text", "[A-Z][a-z]+[A-Z][a-z]+|GNU [A-Z][a-z]+", spark.createDataFrame([("GNU General",), ("GNU Lesser",)], "token string"))


@query(f"""WITH RECURSIVE {SITE}, t AS (SELECT page_id AS id, html AS text, regexp_extract_all(html, '<[^>]*>') AS tags FROM site WHERE html IS NOT NULL),
f AS (
  SELECT id, tags, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS stack, CAST([] AS VARCHAR[]) AS found FROM t
  UNION ALL
  SELECT id, tags, i + 1, CASE WHEN close <> '' THEN stack[1:len(stack) - 1] WHEN name IS NOT NULL THEN list_append(stack, name) ELSE stack END,
    list_concat(found, list_filter([CASE WHEN close <> '' THEN CASE WHEN len(stack) > 0 AND stack[len(stack)] = close THEN NULL ELSE 'unbalanced ' || tag END WHEN name IS NOT NULL THEN CASE WHEN list_contains(stack, name) THEN 'nested ' || name END ELSE 'unsupported ' || tag END,
      CASE WHEN close = '' AND name = 'a' THEN CASE WHEN starts_with(href, '/') AND fresh THEN 'internal link opens a new tab' WHEN starts_with(href, '/') AND href NOT LIKE '%/' THEN 'internal link without a slash' WHEN starts_with(href, 'https://') AND NOT fresh THEN 'external link without new-tab attributes' WHEN NOT starts_with(href, '/') AND NOT starts_with(href, 'https://') THEN 'neither a site path nor https' END END], lambda p: p IS NOT NULL))
  FROM (SELECT *, tags[i + 1] AS tag, regexp_extract(tags[i + 1], '^</([a-zA-Z][a-zA-Z0-9]*)>$', 1) AS close, regexp_extract(tags[i + 1], 'href="([^"]*)"', 1) AS href, contains(tags[i + 1], 'target="_blank" rel="noopener noreferrer"') AS fresh,
    CASE WHEN tags[i + 1] = '<strong>' THEN 'strong' WHEN regexp_matches(tags[i + 1], '^<a href="[^"]+"( target="_blank" rel="noopener noreferrer")?>$') THEN 'a' END AS name FROM f WHERE i < len(tags))
), whole AS (
  SELECT id, list_concat(list_transform(range(len(regexp_extract_all(text, '&')) - len(regexp_extract_all(text, '{S.ENTITY}'))), lambda x: 'bare &'), found, CASE WHEN len(regexp_extract_all(text, '<')) <> len(t.tags) THEN ['stray <'] ELSE CAST([] AS VARCHAR[]) END, list_transform(stack, lambda s: 'unclosed ' || s)) AS problems
  FROM f JOIN t USING (id) WHERE i = len(f.tags)
) SELECT id, CAST(unnest(range(len(problems))) AS INTEGER) AS pos, unnest(problems) AS problem FROM whole""")
def markup_lint(spark, sf):
    return S.markup_lint(site(spark, sf).select(F.col("page_id").alias("id"), F.col("html").alias("text")))


@query(f"""WITH t AS (SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN html ELSE regexp_replace(html, '<[^>]*>', '', 'g') END AS text FROM pages) SELECT id, 'markup' AS problem FROM t WHERE contains(text, '<') UNION ALL SELECT id, 'entity' FROM t WHERE regexp_matches(text, '{S.ENTITY}')""")
def plain_text_lint(spark, sf):
    return S.plain_text_lint(table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(F.regexp_replace("html", "<[^>]*>", "")).alias("text")))


LINKS = f"links AS (SELECT page_id, url, tag, regexp_extract(tag, '{S.HREF}', 1) AS href FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '{S.LINK}')) AS tag FROM site))"


@query(f"""WITH {SITE}, {LINKS}, p AS (SELECT DISTINCT page_id, href, CASE WHEN starts_with(href, '/') AND contains(tag, 'target="_blank" rel="noopener noreferrer"') THEN 'internal link opens a new tab' WHEN starts_with(href, '/') AND href NOT LIKE '%/' THEN 'internal link without a slash'
WHEN starts_with(href, 'https://') AND NOT contains(tag, 'target="_blank" rel="noopener noreferrer"') THEN 'external link without new-tab attributes' WHEN NOT starts_with(href, '/') AND NOT starts_with(href, 'https://') THEN 'neither a site path nor https' END AS problem FROM links) SELECT * FROM p WHERE problem IS NOT NULL""")
def link_lint(spark, sf):
    return S.link_lint(site(spark, sf))


@query("""WITH f AS (SELECT page_id AS id, 'title' AS field, regexp_extract(html, '<title>([^<]*)</title>', 1) AS value FROM pages UNION ALL SELECT page_id, 'h1', regexp_extract(html, '<h1>([^<]*)</h1>', 1) FROM pages UNION ALL SELECT page_id, 'description', regexp_extract(html, 'name="description" content="([^"]*)"', 1) FROM pages),
r(field, least, most) AS (VALUES ('title', 20, 65), ('h1', 15, 70), ('description', 120, 200)), c AS (SELECT id, field, CAST(length(value) AS INTEGER) AS actual, least, most FROM f JOIN r USING (field))
SELECT id, field, CASE WHEN actual < least THEN 'too short' ELSE 'too long' END AS rule, actual FROM c WHERE actual < least OR actual > most""")
def content_bounds(spark, sf):
    rules = spark.createDataFrame([("title", 20, 65), ("h1", 15, 70), ("description", 120, 200)], "field string, least int, most int")
    part = lambda p: F.regexp_extract("html", p, 1)
    fields = F.explode(F.create_map(F.lit("title"), part("<title>([^<]*)</title>"), F.lit("h1"), part("<h1>([^<]*)</h1>"), F.lit("description"), part('name="description" content="([^"]*)"'))).alias("field", "value")
    return S.content_bounds(table(spark, sf, "pages").select(F.col("page_id").alias("id"), fields), rules)


CANON = r"""CASE WHEN regexp_matches(p, '(/|\.[a-z0-9]+)$') THEN p ELSE p || '/' END"""
PATHS = r"paths AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '(^|/)index\.html$', '\1') AS p FROM pages)"


@query(f"""WITH {SITE}, {LINKS}, {PATHS}, a AS (SELECT DISTINCT {CANON} AS slug FROM paths), b AS (SELECT DISTINCT regexp_replace(href, '([^/])$', '\\1/') AS slug FROM links WHERE starts_with(href, '/') UNION SELECT '/en/101/')
SELECT slug, 'orphaned' AS state FROM a WHERE slug NOT IN (SELECT slug FROM b) UNION ALL SELECT slug, 'missing' FROM b WHERE slug NOT IN (SELECT slug FROM a)""")
def registry_reconcile(spark, sf):
    links = S.page_links(site(spark, sf)).where(F.col("href").startswith("/")).select(F.regexp_replace("href", "([^/])$", "$1/").alias("slug")).union(spark.range(1).select(F.lit("/en/101/")))
    return S.registry_reconcile(table(spark, sf, "pages").select(S.canonical_path(F.col("url")).alias("slug")), links)


@query(f"""WITH {SITE}, {LINKS}, e AS (SELECT page_id, href AS target, max(coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1), ''), 'none') <> CASE WHEN lower(substr(href, 2, 1)) < 'o' THEN 'en' ELSE 'fr' END) AS far FROM links GROUP BY page_id, href)
SELECT target, count(*) FILTER (WHERE far) AS inbound, count(*) FILTER (WHERE far) = 0 AS orphan FROM e GROUP BY target""")
def link_graph(spark, sf):
    hub = F.coalesce(F.nullif(F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]+)/", 1), F.lit("")), F.lit("none"))
    far = F.when(F.lower(F.substring("href", 2, 1)) < "o", "en").otherwise("fr")
    return S.link_graph(S.page_links(site(spark, sf)).select(F.col("page_id").alias("page"), hub.alias("hub"), F.col("href").alias("target"), far.alias("target_hub")))


@query("SELECT a.n_name AS slug, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name")
def cross_links(spark, sf):
    return S.cross_links(table(spark, sf, "nation").select(F.col("n_regionkey").alias("suite"), F.col("n_name").alias("slug")))


@query("WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS hub, url AS href, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]*)', 1) ORDER BY page_id, url) AS n FROM pages) SELECT hub, CAST((n - 1) // 1000 AS BIGINT) AS part, string_agg(href, ' ' ORDER BY n) AS hrefs FROM p GROUP BY hub, (n - 1) // 1000")
def hub_rollup(spark, sf):
    return S.hub_rollup(table(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("hub"), F.col("page_id").alias("pos"), F.col("url").alias("href")))


@query(rf"""WITH {PATHS}, c AS (SELECT page_id, url, {CANON} AS canonical FROM paths) SELECT page_id, url, canonical, CASE WHEN regexp_matches(canonical, '^/[a-z]+/4\d+/$') THEN '/b/' ELSE canonical END AS target, CASE WHEN regexp_matches(canonical, '^/[a-z]+/4\d+/$') THEN 2 ELSE 0 END AS hops, false AS looped FROM c""")
def resolve_redirects(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    found = pages.select(S.canonical_path(F.col("url")).alias("source")).where(F.col("source").rlike(r"^/[a-z]+/4\d+/$")).distinct().select("source", F.lit("/a/").alias("destination"))
    return S.resolve_redirects(pages, found.union(spark.range(1).select(F.lit("/a/"), F.lit("/b/"))))


@query("""WITH o AS (SELECT url, min(sha256(CASE WHEN page_id % 7 = 0 THEN html || 'x' ELSE html END)) AS a FROM pages WHERE page_id % 5 > 0 GROUP BY url), n AS (SELECT url, min(sha256(html)) AS b FROM pages WHERE page_id % 6 > 0 GROUP BY url)
SELECT url, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'changed' END AS state FROM o FULL JOIN n USING (url) WHERE a IS DISTINCT FROM b""")
def manifest_diff(spark, sf):
    pages = table(spark, sf, "pages")
    old = pages.where("page_id % 5 > 0").withColumn("html", F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")))
    return S.manifest_diff(D.asset_manifest(old), D.asset_manifest(pages.where("page_id % 6 > 0")))


@query("""WITH r AS (SELECT '/p/' || CAST(json_extract_string(props, '$.k') AS INTEGER) || '/' AS path, CAST(json_extract_string(props, '$.k') AS INTEGER) < 20 OR row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY ts, event_id) > 1 AS hit FROM events WHERE event_type <> 'error')
SELECT path, count(*) AS requests, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE hit) / count(*) AS rate FROM r GROUP BY path""")
def cache_hit_report(spark, sf):
    rows = table(spark, sf, "events")
    path = F.concat(F.lit("/p/"), event_key(rows).cast("string"), F.lit("/"))
    log = rows.select(F.col("user_id").alias("cache"), path.alias("path"), F.when(F.col("event_type") == "error", "POST").otherwise("GET").alias("method"), "ts", F.col("event_id").alias("seq"), event_key(rows).alias("k"))
    return S.cache_hit_report(log.drop("k"), log.where("k < 20").select("path"))


#: Sources and style modules of a page each, as SQL that both sides read alike.
SOURCE_TEXT = """concat('import styles from ', chr(39), './m', CAST(page_id % 5 AS INT), '.module.css', chr(39), ';', chr(10), 'import more from "../shared/n.module.css";', chr(10), 'const a = styles[', chr(39), 'key-', CAST(page_id % 7 AS INT), chr(39), '] + more.', CASE WHEN page_id % 2 = 0 THEN 'pad' ELSE 'gone' END, ';', chr(10), 'other.key = styles.top; // ', substr(html, 1, 40))"""
SOURCE_FILE = "concat('/src/d', CAST(page_id % 50 AS INT), '/f', CAST(page_id AS STRING), '.tsx')"
MODULE_CSS = "concat('.key-', CAST(page_id % 6 AS INT), ':hover{left:0} /* .gone{} */ .pad{top:0}')"
MODULE_NAME = "CASE WHEN page_id % 9 = 0 THEN '/src/shared/n.module.css' ELSE concat('/src/d', CAST(page_id % 50 AS INT), '/m', CAST(page_id % 5 AS INT), '.module.css') END"


@query(f"""WITH s AS (SELECT {SOURCE_FILE} AS file, {SOURCE_TEXT} AS text FROM pages),
i AS (SELECT file, regexp_extract(t, 'import\\s+(\\w+)', 1) AS binding, regexp_extract(t, '[''"]([^''"]+)[''"]$', 1) AS path FROM (SELECT file, unnest(regexp_extract_all(text, 'import\\s+\\w+\\s+from\\s+[''"][^''"]+\\.module\\.css[''"]')) AS t FROM s)),
m AS (SELECT file, binding, CASE WHEN starts_with(path, './') THEN regexp_replace(file, '/[^/]*$', '') || substr(path, 2) ELSE regexp_replace(file, '/[^/]*/[^/]*$', '') || substr(path, 3) END AS module FROM i),
l AS (SELECT file, unnest(string_split(text, chr(10))) AS code, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM s),
u AS (SELECT file, line, regexp_extract(t, '^(\\w+)', 1) AS binding, regexp_replace(t, '^\\w+(\\[''|\\.)|''\\]$', '', 'g') AS key FROM (SELECT file, line, unnest(regexp_extract_all(code, '\\b\\w+(?:\\[''[^'']+''\\]|\\.[A-Za-z_]\\w*)')) AS t FROM l)),
k AS (SELECT DISTINCT module, unnest(regexp_extract_all(regexp_replace(css, '/\\*.*?\\*/', '', 'g'), '\\.(-?[_a-zA-Z][a-zA-Z0-9_-]*)', 1)) AS key FROM (SELECT {MODULE_NAME} AS module, {MODULE_CSS} AS css FROM pages))
SELECT u.file, CAST(line AS INTEGER) AS line, u.binding, u.key, m.module FROM u JOIN m USING (file, binding) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.module = m.module AND k.key = u.key)""")
def undefined_lookups(spark, sf):
    pages = table(spark, sf, "pages")
    return S.undefined_lookups(pages.select(F.expr(SOURCE_FILE).alias("file"), F.expr(SOURCE_TEXT).alias("text")), pages.select(F.expr(MODULE_NAME).alias("module"), F.expr(MODULE_CSS).alias("css")))


CACHES = "SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS origin, concat(CASE WHEN page_id % 4 = 0 THEN 'theirs-' ELSE 'leaf-' END, substr(sha2(html, 256), 1, 8)) AS name, page_id AS created FROM pages"


@query(f"""WITH c AS ({CACHES.replace("sha2(html, 256)", "sha256(html)")}), own AS (SELECT * FROM c WHERE starts_with(name, 'leaf-'))
SELECT DISTINCT origin, name FROM own WHERE name <> (SELECT max_by(o.name, o.created) FROM own o WHERE o.origin = own.origin)""")
def stale_caches(spark, sf):
    pages = table(spark, sf, "pages")
    name = F.concat(F.when(F.col("page_id") % 4 == 0, "theirs-").otherwise("leaf-"), F.substring(F.sha2(F.col("html").cast("binary"), 256), 1, 8))
    return S.stale_caches(pages.select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("origin"), name.alias("name"), F.col("page_id").alias("created")), "leaf-")
