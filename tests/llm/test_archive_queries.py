"""op6_warc against its DuckDB counterpart, on pages of every odd kind and on a given table."""

import duckdb
import pytest

from leafmill.llm.queries import ORACLES, QUERIES

ODD = [
    (3, "HTTPS://www.A.b.com:80/x?y#z", "p"), (1, None, "p"), (2, "", None), (None, " http://q/ ", "p"), (5, "a.b", "\u00e9\n\r\n\r\n"),
    (6, "x://y.z?q", ""), (7, "dup", " long" * 50_000), (7, "dup", "d"), (7, "dup", "d"), (-4, "http://a.b/c d", "WARC/1.1\r\n\r\n"), (8, "bad\r\nurl", "q"),
]


def rows(cursor_rows) -> list[tuple]:
    return sorted((tuple(r) for r in cursor_rows), key=repr)


@pytest.mark.parametrize("kind", ["odd", "empty", "given"])
def test_archives_equal_duckdb(spark, tmp_path, kind):
    folder = "/root/testdata/sf0.001" if kind == "given" else str(tmp_path)
    if kind != "given":
        spark.createDataFrame(ODD if kind == "odd" else [], "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet{'' if kind == 'given' else '/*.parquet'}')")
    want = con.execute(ORACLES["op6_warc"])
    names = [c[0] for c in want.description]
    assert rows(QUERIES["op6_warc"](spark, folder).select(*names).collect()) == rows(want.fetchall())
