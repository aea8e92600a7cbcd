"""Hand-written cases for the rules that the driver's tables do not reach."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions.scalars import name_date, natural_key, rgb, size_label
from leafmill.operators import budget, documents, drafts, editlog, geometry, redaction, site
from leafmill.operators import text as words
from leafmill.sources.tables import doc_pages, page_counts

DOC = "source string, doc_id long, text string"


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("dialect,spec,count,pages,error", [
    ("strict", "", 5, [1, 2, 3, 4, 5], None), ("strict", " 3-1,  4 ", 5, [1, 2, 3, 4], None), ("strict", "8-", 10, [8, 9, 10], None), ("strict", "-3", 5, [1, 2, 3], None),
    ("strict", "6", 5, [], "out of range"), ("strict", "1-6", 5, [], "out of range"), ("strict", "abc", 5, [], "invalid"), ("strict", "1-2-3", 5, [], "invalid"), ("strict", ",,", 5, [], "empty"), ("strict", "-", 5, [], "invalid"), ("strict", "0", 5, [], "out of range"),
    ("clamping", "4-9", 5, [4, 5], None), ("clamping", "8-", 10, [], "invalid"), ("clamping", "7,9", 5, [], "out of range"), ("clamping", ",", 5, [], "empty"), ("clamping", "2, 2,1-2", 5, [1, 2], None),
])
def test_selectors(spark, dialect, spec, count, pages, error):
    docs = spark.createDataFrame([("s", 1, "\n".join(["x"] * 10 * count))], DOC)
    chosen, errors = documents.select_pages(doc_pages(docs), page_counts(docs), spark.createDataFrame([(1, spec)], "doc_id long, spec string"), dialect)
    assert [p for _, p in values(chosen, "doc_id", "page_no")] == pages
    assert [r.reason for r in errors.collect()] == ([error] if error else [])


def test_page_ranges(spark):
    rows = spark.createDataFrame([(1, p) for p in (1, 3, 4, 5, 7, 8)], "doc_id long, page_no int")
    assert documents.page_ranges(rows).first().range_text == "1, 3-5, 7-8"


def test_edit_pages_and_running_numbers(spark):
    docs = spark.createDataFrame([("s", 5, "\n".join(f"l{i}" for i in range(50))), ("s", 2, "one"), ("s", 9, None)], DOC)
    pages = doc_pages(docs)
    assert values(documents.paginate(docs, pages), "running_no", "doc_id", "page_no") == [(1, 2, 1), (2, 5, 1), (3, 5, 2), (4, 5, 3), (5, 5, 4), (6, 5, 5), (7, 9, 1)]
    five = pages.where("doc_id = 5").withColumn("angle", F.lit(270))
    order = five.select("doc_id", "page_no", F.col("page_no").alias("pos"))
    turned = documents.edit_pages(five, order, five.where("page_no in (2, 4)").select("doc_id", "page_no"), five.where("page_no = 3").select("doc_id", "page_no", F.lit(180).alias("delta")))
    assert values(turned, "out_no", "page_no", "angle") == [(1, 1, 270), (2, 3, 90), (3, 5, 270)]


@pytest.mark.parametrize("size,label", [(500, "500 B"), (1536, "1.5 KB"), (15360, "15 KB"), (0, "0 B"), (-1, ""), (5 * 1024**3, "5.0 GB"), (1024**2, "1.0 MB")])
def test_size_label(spark, size, label):
    assert spark.range(1).select(size_label(F.lit(size)).alias("x")).first().x == label


def test_names(spark):
    dates = spark.createDataFrame([("a 2024-13-01.pdf",), ("2023_02_31 x",), ("none",), ("2024.05.06",)], "n string").select(name_date(F.col("n")).cast("string").alias("d"))
    assert [r.d for r in dates.collect()] == ["2025-01-01", "2023-03-03", None, "2024-05-06"]
    names = ["file10", "File2", "éclair", "file1", "Eclair 2"]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key(F.col("n")))
    assert [r.n for r in df.collect()] == ["éclair", "Eclair 2", "file1", "File2", "file10"]


def test_descending_reverses_ties(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "n string, k int")
    up = {r.k: r["rank"] for r in documents.sort_natural(df, "n", "k").collect()}
    down = {r.k: r["rank"] for r in documents.sort_natural(df, "n", "k", descending=True).collect()}
    assert up == {1: 1, 2: 2, 3: 3} and down == {1: 3, 2: 2, 3: 1}


@pytest.mark.parametrize("spans,want", [
    ([(2, 4)], "ab\nefgh"), ([(0, 1), (6, 8)], "\nbcdef\n"), ([(1, 4), (3, 6)], "a\ngh"), ([(1, 3), (3, 5)], "a\nfgh"), ([(6, 99)], "abcdef\n"), ([], "abcdefgh"),
])
def test_cuts(spark, spans, want):
    docs = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    found = redaction.splice_out(docs, spark.createDataFrame([(1, a, b) for a, b in spans], "doc_id long, start long, end long"))
    assert found.first().text == want


def test_redaction_leaves_nothing_and_touches_nothing_else(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.org now, ip 10.0.0.1, card 1234567812345678"), (2, "clean é text"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in redaction.apply_page_edits(docs).collect()}
    assert out[1].text.startswith("mail █████████ now, ip [") and out[1].text.endswith("card " + " " * 16) and out[1].touched
    assert out[2].text == "clean é text" and not out[2].touched and out[3].text is None
    spans = redaction.detect_spans(docs)
    assert all(r.residual == 0 for r in redaction.redaction_audit(redaction.apply_page_edits(docs), spans).collect())


def test_toggles(spark):
    clicks = spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "object_id string")
    assert values(redaction.toggle_marks(clicks, spark.createDataFrame([("a",), ("b",), ("c",)], "object_id string")), "object_id", "marked") == [("a", False), ("b", True), ("c", False)]


def test_bisection_equals_grid():
    """Six halvings of 0.05..0.92 reach the highest of the 64 grid qualities that fits."""
    rng = random.Random(1)
    for _ in range(2_000):
        bound = rng.random()
        low, high = budget.QUALITY_LOW, budget.QUALITY_HIGH
        for _ in range(budget.STEPS):
            mid = (low + high) / 2
            low, high = (mid, high) if mid <= bound else (low, mid)
        grid = [budget.QUALITY_LOW + k * (budget.QUALITY_HIGH - budget.QUALITY_LOW) / 64 for k in range(64)]
        fits = [q for q in grid if q <= bound]
        assert low == pytest.approx(max(fits, default=budget.QUALITY_LOW))


def test_budget_edges(spark):
    docs = spark.createDataFrame([(1, 900, 1), (2, 5_000, 1), (3, 100_000, 9)], "doc_id long, n_chars long, pages int")
    found = {r.doc_id: r for r in budget.fit_to_budget(docs, budget.renditions(docs), 1_000).collect()}
    assert (found[1].tier, found[1].met_target, found[1].bytes) == (0, True, 900)
    assert found[2].met_target and found[2].tier == 3 and found[2].bytes <= 1_000
    assert not found[3].met_target and found[3].quality == pytest.approx(0.05)


@pytest.mark.parametrize("text,fallback,want", [("Hello", None, "ltr"), ("שלום", None, "rtl"), ("12/05 (3)", "rtl", "ltr"), ("", "rtl", "rtl"), ("é", "rtl", "rtl"), ("1 مرحبا a", None, "rtl"), (None, None, "ltr")])
def test_directions(spark, text, fallback, want):
    assert words.text_direction(spark.createDataFrame([(1, text, fallback)], "doc_id long, text string, f string"), "f").first().dir == want


@pytest.mark.parametrize("text,cells,rtl,want", [
    ("27", 4.0, False, [("2", 0.125), ("7", 0.375), ("", 0.625), ("", 0.875)]), ("12345", 3.0, False, [("1", 1 / 6), ("2", 0.5), ("3", 5 / 6)]), ("ab", None, True, [("a", 0.75), ("b", 0.25)]), ("", 0.0, False, [("", 0.5)]),
])
def test_cells(spark, text, cells, rtl, want):
    rows = words.cell_layout(spark.createDataFrame([(1, text, cells, rtl)], "id long, text string, cells double, rtl boolean")).orderBy("idx").collect()
    assert [(r.ch, pytest.approx(r.center)) for r in rows] == want


def test_fonts_are_idempotent(spark):
    fonts = spark.createDataFrame([("Arimo", True, False), ("Gveret Levin", True, True), ("Caveat", False, True)], "family string, hebrew boolean, handwriting boolean")
    texts = spark.createDataFrame([(1, "Caveat", "אב"), (2, "Nope", "אב"), (3, None, "x"), (4, "Nope", "x"), (5, "Gveret Levin", "אב")], "id long, requested string, text string")
    once = words.font_fallback(texts, fonts)
    assert values(once, "id", "resolved") == [(1, "Gveret Levin"), (2, "Arimo"), (3, "Arimo"), (4, "Nope"), (5, "Gveret Levin")]
    again = words.font_fallback(texts.drop("requested").join(once.select("id", F.col("resolved").alias("requested")), "id"), fonts)
    assert values(again, "id", "resolved") == values(once, "id", "resolved")


@pytest.mark.parametrize("handle,delta,want", [
    ("right", (90.0, 0.0), (20, 20, 80, 10)), ("left", (-50.0, 0.0), (0, 20, 40, 10)), ("bottom-right", (-30.0, -30.0), (20, 20, 1, 1)), ("top", (0.0, -90.0), (20, 0, 20, 30)), ("move", (200.0, -200.0), (80, 0, 20, 10)),
])
def test_clamps(spark, handle, delta, want):
    box = spark.createDataFrame([("e", 20.0, 20.0, 20.0, 10.0)], "id string, left double, top double, width double, height double")
    r = geometry.clamp_elements(box, spark.createDataFrame([("e", handle, *delta)], "id string, handle string, dx double, dy double")).first()
    assert (r.left, r.top, r.width, r.height) == want


@pytest.mark.parametrize("box,dw,want", [
    ((40.0, 40.0, 20.0, 10.0), 10.0, (35, 37.5, 30, 15)), ((0.0, 0.0, 20.0, 10.0), 20.0, (0, 0, 40, 20)), ((80.0, 90.0, 20.0, 10.0), 20.0, (60, 80, 40, 20)), ((40.0, 40.0, 20.0, 10.0), 90.0, (20, 30, 60, 30)), ((40.0, 40.0, 20.0, 10.0), -90.0, (49, 44.5, 2, 1)), ((1.0, 2.0, 3.0, 4.0), None, (1, 2, 3, 4)),
])
def test_centred_resizes(spark, box, dw, want):
    boxes = spark.createDataFrame([("e", *box)], "id string, left double, top double, width double, height double")
    r = geometry.resize_centred(boxes, spark.createDataFrame([("e", dw, 2.0, 0.5, 600.0, 600.0)], "id string, dw double, least double, ratio double, page_w double, page_h double")).first()
    assert (r.left, r.top, r.width, r.height) == want


def plain_undo(actions):
    stack, pairs, none = [], {}, set()
    for i, undo in enumerate(actions):
        if not undo:
            stack.append(i)
        elif stack:
            pairs[stack.pop()] = i
        else:
            none.add(i)
    return pairs, none


def test_undo_equals_a_stack(spark):
    rng = random.Random(2)
    logs = {s: [rng.random() < 0.5 for _ in range(rng.randrange(1, 40))] for s in range(60)}
    rows = spark.createDataFrame([(s, i, i, "UNDO" if u else "ADD") for s, log in logs.items() for i, u in enumerate(log)], "session long, ts long, event_id long, action string")
    found = editlog.undo_match(rows).collect()
    for s, log in logs.items():
        pairs, none = plain_undo(log)
        assert {r.event_id: r.undone_by for r in found if r.session == s and r.undone_by is not None} == pairs
        assert {r.event_id for r in found if r.session == s and r.noop} == none


def test_retention_and_handoff_edges(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00.001"), (2, "2024-01-01 00:00:00"), (3, None)], "key long, at string").withColumn("saved_at", F.col("at").cast("timestamp_ntz"))
    assert values(drafts.expire_drafts(rows, F.lit("2024-01-15").cast("timestamp_ntz")), "key", "live") == [(1, True), (2, False), (3, False)]
    log = [(1, "00:00:00", 1, "save", 1.0), (1, "00:05:00", 2, "take", None), (1, "00:05:01", 3, "take", None), (2, "00:00:00", 1, "save", 1.0), (2, "00:05:00.001", 2, "take", None), (2, "00:05:01", 3, "take", None), (3, "00:00:00", 1, "save", None), (3, "00:00:01", 2, "take", None)]
    rows = spark.createDataFrame(log, "key long, at string, seq long, kind string, payload double").withColumn("ts", F.concat(F.lit("2024-01-01 "), "at").cast("timestamp_ntz"))
    assert values(drafts.take_handoff(rows), "key", "seq", "status") == [(1, 2, "ok"), (1, 3, "empty"), (2, 2, "expired"), (2, 3, "empty"), (3, 2, "empty")]


@pytest.mark.parametrize("text,problems", [
    ('<strong>a <a href="/x/">b</a></strong>', []), ("<em>a</em>", ["unsupported <em>", "unbalanced </em>"]), ("a & b &amp; c", ["bare &"]), ("<strong>a", ["unclosed strong"]),
    ("<strong><strong>a</strong></strong>", ["nested strong"]), ("a < b", ["stray <"]), ("</a>", ["unbalanced </a>"]), ('<a href="https://x" target="_blank" rel="noopener noreferrer">x</a>', []),
])
def test_markup(spark, text, problems):
    assert [r.problem for r in site.markup_lint(spark.createDataFrame([(1, text)], "id long, text string")).orderBy("pos").collect()] == problems


def test_policy_by_prefix_and_hashes(spark):
    import base64
    import hashlib

    good = "sha256-" + base64.b64encode(hashlib.sha256(b"ok()").digest()).decode()
    page = f'<meta http-equiv="Content-Security-Policy" content="script-src-elem \'{good}\'; script-src x"><script>ok()</script><script>bad()</script><script src="/a.js"></script><script type="application/ld+json">{{}}</script>'
    found = site.csp_audit(spark.createDataFrame([(1, page), (2, "<p>")], "page_id long, html string")).collect()
    assert sorted((r.page_id, r.tag, r.problem) for r in found) == [(1, "script", "not listed"), (2, "meta", "no policy")]


def test_redirects_and_paths(spark):
    urls = spark.createDataFrame([("https://x.org/a/index.html?q#f",), ("/b",), ("/old/?x",), ("/file.pdf",)], "url string")
    rows = site.resolve_redirects(urls, spark.createDataFrame([("/old/", "/mid/"), ("/mid/", "/new/")], "source string, destination string"))
    assert values(rows, "url", "canonical", "target", "hops") == [("/b", "/b/", "/b/", 0), ("/file.pdf", "/file.pdf", "/file.pdf", 0), ("/old/?x", "/old/", "/new/", 2), ("https://x.org/a/index.html?q#f", "/a/", "/a/", 0)]


def test_any_page_and_pages_not_seen(spark):
    rows = [(1, 0, 7, 0.9), (1, 1, 2, 0.9), (1, 2, 7, 0.1), (1, 3, 2, 0.05), (1, 4, None, 0.9), (2, 0, 3, 0.0), (2, 1, 9, 0.5), (2, 2, 9, 0.0)]
    df = spark.createDataFrame([(s, t, t, p, r) for s, t, p, r in rows], "session long, ts long, seq long, page int, ratio double")
    assert values(drafts.current_page(df), "session", "ts", "page") == [(1, 0, 7), (1, 1, 2), (1, 2, 2), (1, 3, 7), (1, 4, 7), (2, 0, 0), (2, 1, 9), (2, 2, 0)]


def test_numbers_of_any_length(spark):
    names = ["a1000000000000000000002", "a1000000000000000000001", "a0009", "a10", "ŝ2", "S1", "Ærø"]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key(F.col("n")), "n")
    found = [r.n for r in df.collect()]
    assert found[:4] == ["a0009", "a10", "a1000000000000000000001", "a1000000000000000000002"] and found[-2:] == ["S1", "ŝ2"]
    docs = spark.createDataFrame([("s", 1, "x")], DOC)
    pick = lambda spec: documents.select_pages(doc_pages(docs), page_counts(docs), spark.createDataFrame([(1, spec)], "doc_id long, spec string"))
    assert pick("0000000001")[0].count() == 1 and pick("1" * 30)[1].first().reason == "out of range"
    ids = lambda *x: int(editlog.id_seed(spark.createDataFrame([(i,) for i in x], "id string")).first().next_id)
    assert (ids("x", None), ids("el-0"), ids("el-7", "el-007x"), ids("el-100000000000000000000")) == (0, 1, 8, 10**20 + 1)


def test_long_and_looped_redirects(spark):
    chain = [(f"/{i}/", f"/{i + 1}/") for i in range(20)] + [("/x/", "/y/"), ("/y/", "/x/"), ("/z/", "/x/")]
    rows = site.resolve_redirects(spark.createDataFrame([("/0/",), ("/19/",), ("/z/",), ("/q/",)], "url string"), spark.createDataFrame(chain, "source string, destination string"))
    assert sorted((r.url, r.target, r.hops, r.looped) for r in rows.collect()) == [("/0/", "/20/", 20, False), ("/19/", "/20/", 1, False), ("/q/", "/q/", 0, False), ("/z/", None, None, True)]


@pytest.mark.parametrize("text,problems", [("a & b & c", ["bare &", "bare &"]), ('<a href="http://x">y</a>', ["neither a site path nor https"]), ('<a href="">y</a>', ['unsupported <a href="">', "unbalanced </a>"]), ('<a href="/x">y</a> &', ["bare &", "internal link without a slash"])])
def test_links_in_markup(spark, text, problems):
    assert [r.problem for r in site.markup_lint(spark.createDataFrame([(1, text)], "id long, text string")).orderBy("pos").collect()] == problems


def test_collections_span_ranges(spark):
    docs = spark.createDataFrame([("hot" if i % 3 else f"s{i}", i, "\n".join(["x"] * (i % 25))) for i in range(200)], DOC)
    found = documents.paginate(docs, doc_pages(docs)).where("source = 'hot'").orderBy("running_no").collect()
    assert [r.running_no for r in found] == list(range(1, len(found) + 1)) and [r.doc_id for r in found] == sorted(r.doc_id for r in found)


def test_spans_within_the_row_equal_joined_ones(spark):
    docs = spark.createDataFrame([(1, "a.b@c.org 10.0.0.1 x 1234567812345678 This work is licensed to y"), (2, "none"), (3, None), (4, "9.9.9.9@mail.example.org")], "doc_id long, text string")
    spans = redaction.detect_spans(docs)
    assert values(redaction.redact_own(docs), "doc_id", "text", "touched") == values(redaction.redact_text(docs, spans), "doc_id", "text", "touched")
    assert values(redaction.splice_own(docs), "doc_id", "text") == values(redaction.splice_out(docs, spans), "doc_id", "text")
    plan = redaction.apply_page_edits(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("colour,want", [("#ff0080", (1.0, 0.0, 128 / 255)), ("FF0080", (1.0, 0.0, 128 / 255)), ("red", (0.0, 0.0, 0.0)), ("", (0.0, 0.0, 0.0)), (None, (0.0, 0.0, 0.0)), ("#fff", (0.0, 0.0, 0.0))])
def test_colours(spark, colour, want):
    assert tuple(spark.createDataFrame([(colour,)], "c string").select(rgb(F.col("c")).alias("x")).first().x) == pytest.approx(want)


def test_padding_of_families(spark):
    texts = spark.createDataFrame([("Arimo",), ("Pacifico",), ("Nope",)], "family string")
    found = dict(values(words.box_padding(texts, spark.createDataFrame(words.METRICS, "family string, ascent double, descent double")), "family", "padding"))
    assert found == {"Arimo": 0.12, "Nope": 0.12, "Pacifico": pytest.approx((1.303 + 0.453 - 1.05) / 2 + 0.06)}


def test_budgets_within_the_row_equal_joined_ones(spark):
    docs = spark.createDataFrame([(i, n, 1 + i % 9) for i, n in enumerate([0, 900, 1_000, 1_001, 2_500, 5_000, 20_000, 100_000, 10**7])], "doc_id long, n_chars long, pages int")
    names = ("doc_id", "tier", "quality", "bytes", "met_target")
    for target in (1_000, 5_000, 50_000):
        assert sorted(map(str, values(budget.fit_own(docs, target).fillna(-1.0), *names))) == sorted(map(str, values(budget.fit_to_budget(docs, budget.renditions(docs), target).fillna(-1.0), *names)))
