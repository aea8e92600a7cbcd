"""Registered queries over sensitive spans, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import redaction as R
from leafmill.plans.registry import query
from leafmill.sources.tables import event_key, table


def spans_cte(source: str, key: str, text: str, rules: dict[str, str], tag: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT {key}, '{kind}' AS {tag}, m[i] AS value, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start
FROM (SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS m, string_split_regex({text}, '{pattern}') AS g FROM {source}))"""
        for kind, pattern in rules.items()
    )


SPANS = f"spans AS (SELECT doc_id, type, start, start + length(value) AS \"end\", value FROM ({spans_cte('documents', 'doc_id', 'text', R.RULES, 'type')}))"
MERGED = SPANS + """, marked AS (SELECT doc_id, start, "end", max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS (SELECT doc_id, min(start) AS start, max("end") AS "end" FROM islands GROUP BY doc_id, island)"""


def docs(spark, sf):
    return table(spark, sf, "documents")


@query(f'WITH {SPANS} SELECT doc_id, type, start, "end", value FROM spans')
def detect_spans(spark, sf):
    return R.detect_spans(docs(spark, sf))


OBJECTS = f"o AS (SELECT page_id, kind, start, start + length(value) AS \"end\", value FROM ({spans_cte('pages', 'page_id', 'html', R.OBJECTS, 'kind')}))"
IDS = OBJECTS + """, ids AS (SELECT page_id, 'obj-' || page_id || '-' || row_number() OVER (PARTITION BY page_id ORDER BY start, "end", kind) AS id, kind, start, "end", substr(value, 1, 40) AS preview FROM o)"""


@query(f"""WITH {IDS} SELECT page_id, id, kind, start, "end", preview, start * CAST(100 AS DOUBLE) / length(html) AS left_pct, ("end" - start) * CAST(100 AS DOUBLE) / length(html) AS width_pct FROM ids JOIN pages USING (page_id)""")
def page_objects(spark, sf):
    return R.page_objects(table(spark, sf, "pages"))


@query(f'WITH {MERGED} SELECT doc_id, start, "end" FROM merged')
def merge_spans(spark, sf):
    return R.merge_spans(R.detect_spans(docs(spark, sf)))


def cut_sql(source: str, spans: str) -> str:
    """Texts without spans, one line break for each."""
    return f"""(SELECT d.doc_id, CASE WHEN c.s IS NULL THEN text ELSE array_to_string(list_transform(range(0, len(c.s) + 1), lambda k: substr(text, CASE WHEN k = 0 THEN 1 ELSE c.e[k] + 1 END, CASE WHEN k = len(c.s) THEN length(text) ELSE c.s[k + 1] - CASE WHEN k = 0 THEN 0 ELSE c.e[k] END END)), chr(10)) END AS text
FROM {source} d LEFT JOIN (SELECT doc_id, list(start ORDER BY start) AS s, list("end" ORDER BY start) AS e FROM {spans} GROUP BY doc_id) c USING (doc_id))"""


@query(f"WITH {MERGED} SELECT * FROM {cut_sql('documents', 'merged')}")
def splice_out(spark, sf):
    return R.splice_own(docs(spark, sf).select("doc_id", "text"))


def masked_sql(source: str, spans: str) -> str:
    return f"""apart AS (SELECT * FROM (SELECT doc_id, type, greatest(start, coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS start, "end" FROM {spans} WHERE type <> 'delete') WHERE "end" > start),
piece AS (SELECT doc_id, start, "end", CASE WHEN type = 'blur' THEN '[' || substr(sha256('leaf' || substr(text, start + 1, "end" - start)), 1, 8) || ']' ELSE repeat(CASE WHEN type = 'whiteout' THEN ' ' ELSE '█' END, "end" - start) END AS new,
  substr(text, coalesce(lag("end") OVER w, 0) + 1, start - coalesce(lag("end") OVER w, 0)) AS before FROM apart JOIN {source} USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY start)),
joined AS (SELECT doc_id, string_agg(before || new, '' ORDER BY start) AS head, max("end") AS last FROM piece GROUP BY doc_id),
redacted AS (SELECT doc_id, coalesce(head || substr(text, last + 1), text) AS text, head IS NOT NULL AS touched FROM {source} LEFT JOIN joined USING (doc_id))"""


@query(f"WITH {SPANS}, {masked_sql('documents', 'spans')} SELECT * FROM redacted")
def redact_text(spark, sf):
    return R.redact_own(docs(spark, sf).select("doc_id", "text"))


DELETED = {k: v for k, v in R.RULES.items() if k == "delete"}
MASKED = {k: v for k, v in R.RULES.items() if k != "delete"}
EDITED = f"""del AS (SELECT doc_id, start, start + length(value) AS "end" FROM ({spans_cte('documents', 'doc_id', 'text', DELETED, 'type')})), kept AS (SELECT * FROM {cut_sql('documents', 'del')}),
again AS (SELECT doc_id, type, start, start + length(value) AS "end" FROM ({spans_cte('kept', 'doc_id', 'text', MASKED, 'type')})), {masked_sql('kept', 'again')}"""


@query(f"WITH {EDITED} SELECT * FROM redacted")
def apply_page_edits(spark, sf):
    return R.apply_page_edits(docs(spark, sf).select("doc_id", "text"))


@query(f"""WITH {SPANS} SELECT d.doc_id, count(*) FILTER (WHERE type = 'blackout') AS blackout, count(*) FILTER (WHERE type = 'whiteout') AS whiteout, count(*) FILTER (WHERE type = 'blur') AS blur, count(*) FILTER (WHERE type = 'delete') AS "delete", count(type) > 0 AS touched
FROM documents d LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id""")
def redaction_summary(spark, sf):
    return R.redaction_summary(docs(spark, sf), R.detect_spans(docs(spark, sf)))


@query(f"""WITH {SPANS}, {EDITED} SELECT v.doc_id, count(*) AS removed, count(*) FILTER (WHERE contains(r.text, v.value)) AS residual
FROM (SELECT DISTINCT doc_id, value FROM spans) v JOIN redacted r USING (doc_id) GROUP BY v.doc_id""")
def redaction_audit(spark, sf):
    return R.edit_audit(docs(spark, sf))


@query(f"""WITH {IDS}, clicks AS (SELECT 'obj-' || (user_id % 250) || '-' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 7) AS object_id FROM events WHERE event_type = 'click'),
odd AS (SELECT object_id FROM clicks GROUP BY object_id HAVING count(*) % 2 = 1) SELECT id AS object_id, id IN (SELECT object_id FROM odd) AS marked FROM ids""")
def toggle_marks(spark, sf):
    events = table(spark, sf, "events").where("event_type = 'click'")
    clicks = events.select(F.concat(F.lit("obj-"), (F.col("user_id") % 250).cast("string"), F.lit("-"), (event_key(events) % 7).cast("string")).alias("object_id"))
    return R.toggle_marks(clicks, R.page_objects(table(spark, sf, "pages")).select(F.col("id").alias("object_id")))
