"""Audits of a crawl: what is extracted from its HTML, and the rules that are checked on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.ranks import with_running_sum
from leafmill.sources.store import stored

#: Patterns that Java's and RE2's expressions read alike.
LINK = r'<a [^>]*href="[^"]*"[^>]*>'
HREF = r'href="([^"]*)"'
CLASS_ATTRIBUTE = r'\sclass="([^"]*)"'
STYLE_BLOCK = r"<style[^>]*>([^<]*)</style>"
STYLED = r'<[a-zA-Z][^>]* style="[^"]*"[^>]*>'
#: A rule, or an at-rule that holds rules one level deep.
CSS_BLOCK = r"((?:@[^{}]+\{(?:[^{}]+\{[^{}]*\})*[^{}]*\})|(?:[^{}@]+\{[^{}]*\}))"
CSS_RULE = r"([^{}@]+\{[^{}]*\})"
SELECTOR_CLASS = r"\.((?:\\.|[a-zA-Z0-9_-])+)"
HASHED = r"^_.+_[a-z0-9]+_\d+$"
IMAGE = r"<img [^>]*>"
SCRIPT_SRC = r'<script[^>]* src="([^"]*)"'
TAG = r"<[^>]*>"
ENTITY = r"&(?:amp|lt|gt|quot|#39);"
#: Tags that every page must have, as rule and pattern.
SEO_RULES = {
    "title": r"<title[^>]*>",
    "description": r'<meta[^>]* name="description"',
    "canonical": r'<link[^>]* rel="canonical"',
    **{k: f'<meta[^>]* property="{k}"' for k in ("og:title", "og:description", "og:url", "og:type")},
    **{k: f'<meta[^>]* name="{k}"' for k in ("twitter:card", "twitter:title", "twitter:description")},
}
JSON_LD = r'<script type="application/ld\+json">([^<]*)</script>'
#: Byte limits of a page's document and scripts, and of its images.
PAGE_LIMIT, IMAGE_LIMIT = 48_000, 15_000


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})" if group == 0 else pattern), F.lit(1 if group == 0 else group))


def decoded(text: Column) -> Column:
    """Five entities, the ampersand first."""
    for entity, mark in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return text


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, url, tag, href of every link with a target."""
    rows = pages.select("page_id", "url", F.explode(every(F.col("html"), LINK)).alias("tag"))
    return rows.withColumn("href", F.regexp_extract("tag", HREF, 1))


def page_classes(pages: DataFrame) -> DataFrame:
    """page_id, class: each class once a page."""
    names = F.flatten(F.transform(every(F.col("html"), CLASS_ATTRIBUTE, 1), lambda a: F.split(decoded(a), r"\s+")))
    return pages.select("page_id", F.explode(F.array_distinct(names)).alias("class")).where("class <> ''")


def css_rules(pages: DataFrame) -> DataFrame:
    """page_id, context (the at-rule around it, or nothing), prelude, text of every rule as it stands in the page."""
    blocks = pages.select("page_id", F.explode(every(F.col("html"), STYLE_BLOCK, 1)).alias("css")).select("page_id", F.explode(every(F.col("css"), CSS_BLOCK, 1)).alias("block")).withColumn("block", F.trim("block"))
    at = F.col("block").startswith("@")
    context = F.when(at, F.trim(F.substring_index("block", "{", 1))).otherwise("")
    inner = F.when(at, F.substring("block", F.instr("block", "{") + 1, F.length("block") - F.instr("block", "{") - 1)).otherwise(F.col("block"))
    rules = blocks.select("page_id", context.alias("context"), F.explode(every(inner, CSS_RULE, 1)).alias("text")).withColumn("text", F.trim("text"))
    return rules.select("page_id", "context", F.trim(F.substring_index("text", "{", 1)).alias("prelude"), "text")


def selector_classes(prelude: Column) -> Column:
    return F.transform(every(prelude, SELECTOR_CLASS, 1), lambda c: F.regexp_replace(c, r"\\", ""))


def seo_audit(pages: DataFrame) -> DataFrame:
    """page_id, rule, detail of every rule that a page breaks; error pages and verification files are skipped."""
    audited = pages.where(~F.col("url").contains("404") & ~F.col("url").contains("google"))
    heads = F.regexp_count(F.col("html"), F.lit(r"<h1[ >]"))
    broken = [F.when(heads != 1, F.struct(F.lit("h1").alias("rule"), heads.cast("string").alias("detail")))]
    broken += [F.when(~F.col("html").rlike(p), F.struct(F.lit(k).alias("rule"), F.lit("missing").alias("detail"))) for k, p in SEO_RULES.items()]
    data = every(F.col("html"), JSON_LD, 1)
    kinds = F.transform(data, lambda b: F.get_json_object(b, "$.@type"))
    broken.append(F.when(F.exists(data, lambda b: F.get_json_object(b, "$").isNull()), F.struct(F.lit("json_ld").alias("rule"), F.lit("invalid").alias("detail"))))
    broken.append(F.when(~F.exists(kinds, lambda k: k.eqNullSafe(F.lit("SoftwareApplication"))) & ~F.col("url").contains("licenses"), F.struct(F.lit("software_application").alias("rule"), F.lit("missing").alias("detail"))))
    rows = audited.select("page_id", F.explode(F.filter(F.array(*broken), lambda r: r.isNotNull())).alias("r"))
    return rows.select("page_id", "r.rule", "r.detail")


def faq_match(pages: DataFrame) -> DataFrame:
    """page_id, idx, schema_q, page_q where the questions of the last FAQPage JSON-LD and of the page differ.

    A different number of questions leaves one side null; a page with questions and no JSON-LD has every row so.
    """
    blocks = every(F.col("html"), JSON_LD, 1)
    faq = F.try_element_at(F.filter(blocks, lambda b: F.get_json_object(b, "$.@type") == "FAQPage"), F.lit(-1))
    schema = F.transform(F.from_json(F.get_json_object(faq, "$.mainEntity"), "array<struct<name:string>>"), lambda e: F.trim(e["name"]))
    shown = F.transform(every(F.col("html"), r'class="faq-(?:item|card)"[^>]*>\s*<h3[^>]*>([^<]*)</h3>', 1), lambda q: F.trim(q))
    none = F.array().cast("array<string>")
    both = F.arrays_zip(F.coalesce(schema, none).alias("schema_q"), shown.alias("page_q"))
    rows = pages.select("page_id", F.posexplode(both).alias("idx", "q")).select("page_id", "idx", "q.schema_q", "q.page_q")
    return rows.where(~F.col("schema_q").eqNullSafe(F.col("page_q")))


def csp_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256-"), F.base64(F.unhex(F.sha2(text.cast("binary"), 256))))


def csp_audit(pages: DataFrame) -> DataFrame:
    """page_id, tag, hash, problem: inline scripts and styles that the page's policy does not list.

    The first directive whose name begins with script-src (or style-src) counts. JSON-LD and scripts with a source are
    skipped; a page without a policy gives one warning row.
    """
    policy = F.regexp_extract("html", r'<meta http-equiv="Content-Security-Policy" content="([^"]*)"', 1)
    directive = lambda name: F.coalesce(F.get(F.filter(F.transform(F.split(policy, ";"), lambda d: F.trim(d)), lambda d: d.startswith(name)), 0), F.lit(""))
    scripts = F.transform(F.filter(every(F.col("html"), r"<script[^>]*>[^<]*</script>"), lambda s: ~F.regexp_extract(s, r"^<script([^>]*)>", 1).rlike(r' src=|application/ld\+json')), lambda s: F.struct(F.lit("script").alias("tag"), csp_hash(F.regexp_extract(s, r"^<script[^>]*>([^<]*)</script>$", 1)).alias("hash")))
    styles = F.transform(every(F.col("html"), STYLE_BLOCK, 1), lambda s: F.struct(F.lit("style").alias("tag"), csp_hash(s).alias("hash")))
    found = pages.select("page_id", (policy == "").alias("bare"), directive("script-src").alias("script"), directive("style-src").alias("style"), F.concat(scripts, styles).alias("found"))
    warned = found.where("bare").select("page_id", F.lit("meta").alias("tag"), F.lit("").alias("hash"), F.lit("no policy").alias("problem"))
    rows = found.where("not bare").select("page_id", "script", "style", F.explode("found").alias("f"))
    listed = F.when(F.col("f.tag") == "script", F.col("script")).otherwise(F.col("style"))
    missing = rows.where(~F.array_contains(F.split(listed, r"\s+"), F.concat(F.lit("'"), F.col("f.hash"), F.lit("'"))))
    return missing.select("page_id", "f.tag", "f.hash", F.lit("not listed").alias("problem")).unionByName(warned)


def inline_style_audit(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode(every(F.col("html"), STYLED)).alias("tag")).select("page_id", F.substring("tag", 1, 150).alias("snippet"))


def page_weight(pages: DataFrame, assets: DataFrame, page_limit: int = PAGE_LIMIT, image_limit: int = IMAGE_LIMIT) -> DataFrame:
    """page_id, doc, js, img, total, over_total, over_img. Bytes are raw; the total leaves images out.

    Of an image's candidates the largest counts (the first of equals), lazy images don't, and a URL counts once a page.
    """
    scripts = pages.select("page_id", F.explode(F.array_distinct(every(F.col("html"), SCRIPT_SRC, 1))).alias("url"))
    js = scripts.join(assets, "url").groupBy("page_id").agg(F.sum("bytes").alias("js"))
    tags = pages.select("page_id", F.posexplode(every(F.col("html"), IMAGE)).alias("n", "tag")).where(~F.col("tag").rlike(r'(?i) loading="?lazy'))
    srcset, src = F.regexp_extract("tag", r' srcset="([^"]*)"', 1), F.regexp_extract("tag", r' src="([^"]*)"', 1)
    urls = F.when(srcset != "", F.transform(F.split(srcset, ","), lambda c: F.substring_index(F.trim(c), " ", 1))).otherwise(F.array(src))
    candidates = tags.select("page_id", "n", F.posexplode(urls).alias("k", "url")).withColumn("url", F.substring_index("url", "?", 1)).join(assets, "url")
    chosen = candidates.groupBy("page_id", "n").agg(F.max_by(F.struct("url", "bytes"), F.struct(F.col("bytes"), -F.col("k"))).alias("c"))
    img = chosen.select("page_id", "c.url", "c.bytes").distinct().groupBy("page_id").agg(F.sum("bytes").alias("img"))
    rows = pages.select("page_id", F.octet_length("html").cast("long").alias("doc")).join(js, "page_id", "left").join(img, "page_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    total = F.col("doc") + zero(F.col("js"))
    return rows.select("page_id", "doc", zero(F.col("js")).alias("js"), zero(F.col("img")).alias("img"), total.alias("total"), (total > page_limit).alias("over_total"), (zero(F.col("img")) > image_limit).alias("over_img"))


def worst_pages(weights: DataFrame) -> DataFrame:
    """budget, page_id, bytes, over of the heaviest page of page_weight() for its total and for its images; of equal ones the smallest id."""
    top = lambda size, over: F.max_by(F.struct("page_id", F.col(size).alias("bytes"), F.col(over).alias("over")), F.struct(size, -F.col("page_id")))
    both = weights.agg(top("total", "over_total").alias("total"), top("img", "over_img").alias("img"))
    rows = both.select(F.explode(F.create_map(F.lit("total"), "total", F.lit("img"), "img")).alias("budget", "worst"))
    return rows.where("worst is not null").select("budget", "worst.*")


def css_duplication(rules: DataFrame) -> DataFrame:
    """shipped, distinct, factor; a rule is its context and text."""
    sized = rules.groupBy("context", "text").agg(F.count("*").alias("n")).withColumn("bytes", F.octet_length("text").cast("long"))
    return sized.agg(F.sum(F.col("n") * F.col("bytes")).alias("shipped"), F.sum("bytes").alias("distinct")).withColumn("factor", F.col("shipped") / F.col("distinct"))


def _classed(rules: DataFrame) -> DataFrame:
    """Rules with classes and without hashed ones; identical rules of a page are counted in n."""
    own = rules.groupBy("page_id", "context", "prelude", "text").agg(F.count("*").alias("n")).withColumn("classes", selector_classes(F.col("prelude")))
    group = F.when(F.col("context").rlike(r"^@layer\s+utilities\b"), "utilities").otherwise("global")
    return own.where((F.size("classes") > 0) & ~F.exists("classes", lambda c: c.rlike(HASHED))).select("page_id", "text", "context", "n", "classes", group.alias("grp"))


def css_dead_bytes(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """page_id, grp, dead, live: bytes of rules none of whose classes the page uses, and of the others."""
    own = _classed(rules)
    used = own.select("page_id", "context", "text", F.explode("classes").alias("class")).join(classes, ["page_id", "class"], "left_semi").select("page_id", "context", "text").distinct().withColumn("used", F.lit(True))
    rows = own.join(used, ["page_id", "context", "text"], "left").withColumn("bytes", (F.octet_length("text") * F.col("n")).cast("long"))
    return rows.groupBy("page_id", "grp").agg(F.sum(F.when(F.col("used"), 0).otherwise(F.col("bytes"))).alias("dead"), F.sum(F.when(F.col("used"), F.col("bytes")).otherwise(0)).alias("live"))


def single_page_classes(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """class, page_id of the utility classes that one page alone uses."""
    utilities = _classed(rules).where("grp = 'utilities'").select(F.explode("classes").alias("class")).distinct()
    used = classes.join(utilities, "class", "left_semi").groupBy("class").agg(F.min("page_id").alias("page_id"), F.max("page_id").alias("last"))
    return used.where("page_id = last").select("class", "page_id")


def dead_classes(classes: DataFrame, rules: DataFrame, allowed: list[str], prefixes: list[str]) -> DataFrame:
    """class, pages, sample (the first three pages) of the classes without a rule anywhere that are not allowed."""
    ruled = rules.select(F.explode(selector_classes(F.col("prelude"))).alias("class")).distinct()
    fine = F.col("class").isin(allowed)
    for prefix in prefixes:
        fine = fine | F.col("class").startswith(prefix)
    rows = classes.where(~fine).join(ruled, "class", "left_anti")
    place = F.row_number().over(Window.partitionBy("class").orderBy("page_id"))
    counted = rows.groupBy("class").agg(F.count("*").alias("pages"))
    first = rows.withColumn("n", place).where("n <= 3").groupBy("class").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda p: p.cast("string")), ",").alias("sample"))
    return counted.join(first, "class")


def class_resolution(uses: DataFrame, rules: DataFrame, owners: DataFrame, imports: DataFrame, allowed: list[str]) -> DataFrame:
    """file, class, verdict of each use: global, allowed, no_rule, owner_imported_but_raw or owner_not_imported."""
    glob = rules.select("class", F.lit(True).alias("ruled")).distinct()
    owned = owners.select("class", F.lit(True).alias("owned")).distinct()
    near = uses.join(owners, "class").join(imports, ["file", "module"]).select("file", "class", F.lit(True).alias("imported")).distinct()
    rows = uses.select("file", "class").distinct().join(glob, "class", "left").join(owned, "class", "left").join(near, ["file", "class"], "left")
    verdict = F.when(F.col("ruled"), "global").when(F.col("class").isin(allowed), "allowed").when(F.col("owned").isNull(), "no_rule").when(F.col("imported"), "owner_imported_but_raw").otherwise("owner_not_imported")
    return rows.select("file", "class", verdict.alias("verdict"))


def pattern_ratchet(texts: DataFrame, column: str, pattern: str, allowed: DataFrame) -> DataFrame:
    """token, state: unexpected (found, not allowed) or missing (allowed, not found)."""
    found = texts.select(F.explode(every(F.col(column), pattern)).alias("token")).distinct()
    return found.exceptAll(allowed).withColumn("state", F.lit("unexpected")).unionByName(allowed.distinct().exceptAll(found).withColumn("state", F.lit("missing")))


NEW_TAB = 'target="_blank" rel="noopener noreferrer"'


def href_problem(href: Column, new_tab: Column) -> Column:
    """What is wrong with a link, or null."""
    inside, outside = href.startswith("/"), href.startswith("https://")
    return (
        F.when(inside & new_tab, "internal link opens a new tab").when(inside & ~href.endswith("/"), "internal link without a slash")
        .when(outside & ~new_tab, "external link without new-tab attributes").when(~inside & ~outside, "neither a site path nor https")
    )


def markup_lint(texts: DataFrame) -> DataFrame:
    """id, pos, problem of texts (id, text) that may hold <strong> and <a href> only, nested in one another and closed.

    First each bare ampersand, then the tags' problems in their order, a stray <, and what is left open.
    """
    tags = every(F.col("text"), TAG)
    kind = lambda t: F.when(t == "<strong>", "strong").when(t.rlike(r'^<a href="[^"]+"( target="_blank" rel="noopener noreferrer")?>$'), "a")
    none = F.array().cast("array<string>")

    def step(acc: Column, tag: Column) -> Column:
        name, close = kind(tag), F.regexp_extract(tag, r"^</([a-zA-Z][a-zA-Z0-9]*)>$", 1)
        size = F.size(acc["stack"])
        top = F.when(size > 0, F.element_at(acc["stack"], F.when(size > 0, -1).otherwise(F.lit(None))))
        first = F.when(close != "", F.when(top.eqNullSafe(close), F.lit(None)).otherwise(F.concat(F.lit("unbalanced "), tag)))
        first = first.when(name.isNotNull(), F.when(F.array_contains(acc["stack"], name), F.concat(F.lit("nested "), name))).otherwise(F.concat(F.lit("unsupported "), tag))
        link = F.when((close == "") & (name == "a"), href_problem(F.regexp_extract(tag, HREF, 1), tag.contains(NEW_TAB)))
        new = F.array_compact(F.array(first, link))
        stack = F.when(close != "", F.slice(acc["stack"], 1, F.greatest(size - 1, F.lit(0)))).when(name.isNotNull(), F.concat(acc["stack"], F.array(name))).otherwise(acc["stack"])
        return F.struct(stack.alias("stack"), F.concat(acc["out"], new).alias("out"))

    folded = F.aggregate(tags, F.struct(none.alias("stack"), none.alias("out")), step)
    stray = F.when(F.regexp_count(F.col("text"), F.lit("<")) != F.size(tags), F.array(F.lit("stray <"))).otherwise(none)
    bare = F.array_repeat(F.lit("bare &"), F.regexp_count(F.col("text"), F.lit("&")) - F.regexp_count(F.col("text"), F.lit(ENTITY)))
    rows = texts.where("text is not null").withColumn("f", folded)
    problems = F.concat(bare, F.col("f.out"), stray, F.transform("f.stack", lambda s: F.concat(F.lit("unclosed "), s)))
    return rows.select("id", F.posexplode(problems).alias("pos", "problem"))


def plain_text_lint(texts: DataFrame) -> DataFrame:
    """id, problem: a plain field holds markup or an entity."""
    found = F.array(F.when(F.contains("text", F.lit("<")), "markup"), F.when(F.col("text").rlike(ENTITY), "entity"))
    return texts.select("id", F.explode(F.filter(found, lambda p: p.isNotNull())).alias("problem"))


def link_lint(pages: DataFrame) -> DataFrame:
    """page_id, href, problem: site paths end in a slash and open in place, other links are https and open a new tab."""
    problem = href_problem(F.col("href"), F.col("tag").contains(NEW_TAB))
    return page_links(pages).select("page_id", "href", problem.alias("problem")).where("problem is not null").distinct()


def content_bounds(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """id, field, rule, actual of every field (id, field, value) outside its rule (field, least, most); rules are a few rows."""
    rows = fields.join(F.broadcast(rules), "field").withColumn("actual", F.length(F.coalesce("value", F.lit(""))))
    rule = F.when(F.col("actual") < F.col("least"), "too short").when(F.col("actual") > F.col("most"), "too long")
    return rows.select("id", "field", rule.alias("rule"), "actual").where("rule is not null")


def registry_reconcile(content: DataFrame, registry: DataFrame) -> DataFrame:
    """slug, state of what stands on one side only: orphaned (content) or missing (registry)."""
    a, b = content.select("slug", F.lit(True).alias("a")).distinct(), registry.select("slug", F.lit(True).alias("b")).distinct()
    return a.join(b, "slug", "full_outer").where("a is null or b is null").select("slug", F.when(F.col("b").isNull(), "orphaned").otherwise("missing").alias("state"))


def link_graph(edges: DataFrame) -> DataFrame:
    """target, inbound, orphan of edges (page, hub, target, target_hub): pages of other hubs that link to it."""
    far = ~F.col("hub").eqNullSafe(F.col("target_hub"))
    once = edges.groupBy("target", "page").agg(F.max(far).alias("far"))
    return once.groupBy("target").agg(F.count_if("far").alias("inbound")).withColumn("orphan", F.col("inbound") == 0)


def cross_links(items: DataFrame) -> DataFrame:
    """slug, other: each item with every other item of its suite. Suites are small by design: the result is their square."""
    other = items.select(F.col("suite").alias("s"), F.col("slug").alias("other"))
    return items.join(other, (F.col("suite") == F.col("s")) & (F.col("slug") != F.col("other"))).select("slug", "other")


HUB_PART = 1_000


def hub_rollup(pages: DataFrame) -> DataFrame:
    """hub, part, hrefs (in order of pos, blank-joined): at most HUB_PART of a hub's pages a part."""
    placed = with_running_sum(pages.withColumn("one", F.lit(1).cast("long")), ["hub"], ["pos", "href"], "one", "before")
    rows = placed.withColumn("n", F.col("before") + 1).groupBy("hub", F.floor((F.col("n") - 1) / HUB_PART).alias("part")).agg(F.array_sort(F.collect_list(F.struct("n", "href"))).alias("all"))
    return rows.select("hub", "part", F.array_join("all.href", " ").alias("hrefs"))


def canonical_path(url: Column) -> Column:
    """The path without scheme, host, query and fragment; index.html goes, a final slash comes."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-z]+://[^/]*", "")
    path = F.regexp_replace(path, r"(^|/)index\.html$", "$1")
    return F.when(path.endswith("/") | path.rlike(r"\.[a-z0-9]+$"), path).otherwise(F.concat(path, F.lit("/")))


def redirect_ends(redirects: DataFrame) -> DataFrame:
    """source, target, hops, looped of redirects (source, destination; the smallest of several destinations counts).

    Each round every source takes its destination's way in one step, so a chain of n hops takes about log2(n) rounds. A
    source that still has a way to go after more hops than there are sources is in a loop, or leads into one.
    """
    own = stored(redirects.groupBy("source").agg(F.min("destination").alias("target")).withColumn("hops", F.lit(1).cast("long")), "redirects")
    most, reach = own.count(), 1
    while True:
        step = own.select(F.col("source").alias("target"), F.col("target").alias("_next"), F.col("hops").alias("_more"))
        met = own.join(step, "target", "left")
        if reach > most or met.where("_next is not null").isEmpty():
            return met.select("source", "target", "hops", F.col("_next").isNotNull().alias("looped"))
        own = stored(met.select("source", F.coalesce("_next", "target").alias("target"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops")), "redirects")
        reach *= 2


def resolve_redirects(urls: DataFrame, redirects: DataFrame) -> DataFrame:
    """urls with canonical, target, hops, looped: redirects (source, destination) are followed to their end; a loop leads nowhere."""
    rows = urls.withColumn("canonical", canonical_path(F.col("url")))
    ends = redirect_ends(redirects).select(F.col("source").alias("canonical"), F.col("target").alias("_to"), "hops", "looped")
    looped = F.coalesce("looped", F.lit(False))
    rows = rows.join(ends, "canonical", "left")
    return rows.select(*urls.columns, "canonical", F.when(~looped, F.coalesce("_to", "canonical")).alias("target"), F.when(~looped, F.coalesce("hops", F.lit(0))).alias("hops"), looped.alias("looped"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """url, state: added, removed or changed between two manifests (url, sha256)."""
    rows = old.select("url", F.col("sha256").alias("a")).join(new.select("url", F.col("sha256").alias("b")), "url", "full_outer")
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return rows.select("url", state.alias("state")).where("state is not null")


def cache_hit_report(log: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, requests, hits, rate of the GET requests (cache, path, method, ts, seq): a hit is in the manifest or was asked before."""
    asked = log.where("method = 'GET'").withColumn("n", F.row_number().over(Window.partitionBy("cache", "path").orderBy("ts", "seq")))
    rows = asked.join(manifest.select("path", F.lit(True).alias("listed")).distinct(), "path", "left").withColumn("hit", F.coalesce("listed", F.lit(False)) | (F.col("n") > 1))
    return rows.groupBy("path").agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits")).withColumn("rate", F.col("hits") / F.col("requests"))


IMPORT = r"import\s+\w+\s+from\s+['\"][^'\"]+\.module\.css['\"]"
LOOKUP = r"\b\w+(?:\['[^']+'\]|\.[A-Za-z_]\w*)"
COMMENT = r"(?s)/\*.*?\*/"
MODULE_CLASS = r"\.(-?[_a-zA-Z][a-zA-Z0-9_-]*)"


def resolved_path(file: Column, path: Column) -> Column:
    """A path relative to a file's folder, without `.` and `..`; a path from the root stays."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_replace(file, "[^/]*$", ""), path))
    parts = F.filter(F.split(whole, "/"), lambda s: ~s.isin("", "."))
    step = lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def module_imports(sources: DataFrame) -> DataFrame:
    """file, binding, module of the style modules that sources (file, text) import; of a binding's imports the last counts."""
    rows = sources.select("file", F.posexplode(every(F.col("text"), IMPORT)).alias("n", "line"))
    named = rows.select("file", "n", F.regexp_extract("line", r"import\s+(\w+)", 1).alias("binding"), resolved_path(F.col("file"), F.regexp_extract("line", r"['\"]([^'\"]+)['\"]$", 1)).alias("module"))
    return named.groupBy("file", "binding").agg(F.max_by("module", "n").alias("module"))


def undefined_lookups(sources: DataFrame, modules: DataFrame) -> DataFrame:
    """file, line (from 1), binding, key, module: look-ups binding['key'] or binding.key of a class that the module does not have.

    Sources are (file, text), modules (module, css); comments of a style sheet define nothing, a module that is not there has
    no class. A look-up stands within one line; each place gives one row, also one in a comment or in a path (`t.module.css` under a binding t).
    """
    keys = modules.select("module", F.explode(every(F.regexp_replace("css", COMMENT, ""), MODULE_CLASS, 1)).alias("key")).distinct()
    lines = sources.select("file", F.posexplode(F.split("text", "\n")).alias("line", "code"))
    uses = lines.select("file", (F.col("line") + 1).alias("line"), F.explode(every(F.col("code"), LOOKUP)).alias("use"))
    split = uses.select("file", "line", F.regexp_extract("use", r"^(\w+)", 1).alias("binding"), F.regexp_replace("use", r"^\w+(?:\['|\.)|'\]$", "").alias("key"))
    return split.join(module_imports(sources), ["file", "binding"]).join(keys, ["module", "key"], "left_anti").select("file", "line", "binding", "key", "module")


def stale_caches(caches: DataFrame, prefix: str) -> DataFrame:
    """origin, name of the caches (origin, name, created) with the own prefix that are not their origin's newest.

    Caches of another prefix belong to others and stay, as do those without a name. Of equal times the larger name is the newer.
    """
    own = caches.where(F.col("name").startswith(prefix)).select("origin", "name", "created")
    newest = own.groupBy(F.col("origin").alias("_origin")).agg(F.max(F.struct("created", "name"))["name"].alias("_newest"))
    return own.join(newest, F.col("origin").eqNullSafe(F.col("_origin"))).where("name <> _newest").select("origin", "name").distinct()
