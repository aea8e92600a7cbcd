"""Catalogues of a few rows: long texts are not shuffled by their few keys."""

import pytest

from leafmill.operators import site as S
from leafmill.operators import text as T


@pytest.fixture
def jobs(spark):
    texts = spark.createDataFrame([(1, "Caveat", "plain"), (2, "Caveat", "שלום"), (3, "Inter", "שלום"), (4, "", None), (5, None, "א"), (6, "Heebo", "א"), (7, "Lost", "x")], "id long, requested string, text string")
    fonts = spark.createDataFrame([("Heebo", True, False), ("Caveat", False, True), ("Inter", False, False)], "family string, hebrew boolean, handwriting boolean")
    padded = spark.createDataFrame([(1, "Arimo"), (2, "Lost"), (3, None)], "id long, family string")
    fields = spark.createDataFrame([(1, "title", "short"), (2, "title", None), (3, "h1", "x" * 80), (4, "other", "x")], "id long, field string, value string")
    rules = spark.createDataFrame([("title", 5, 65), ("h1", 15, 70)], "field string, least int, most int")
    return {
        "fonts": (T.font_fallback(texts, fonts), [(1, "Caveat", "Caveat"), (2, "Caveat", "Gveret Levin"), (3, "Inter", "Arimo"), (4, "", "Arimo"), (5, None, "Arimo"), (6, "Heebo", "Heebo"), (7, "Lost", "Lost")]),
        "padding": (T.box_padding(padded, spark.createDataFrame([("Arimo", 0.905, 0.212)], "family string, ascent double, descent double")).selectExpr("id", "family", "padding >= 0.12"), [(1, "Arimo", True), (2, "Lost", True), (3, None, True)]),
        "bounds": (S.content_bounds(fields, rules), [(2, "title", "too short", 0), (3, "h1", "too long", 80)]),
    }


@pytest.mark.parametrize("name", ["fonts", "padding", "bounds"])
def test_a_catalogue_is_sent_to_the_rows(jobs, name):
    found, want = jobs[name]
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == want
