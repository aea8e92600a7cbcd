"""Registered queries over edit logs and keyed records, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import drafts as H
from leafmill.operators import editlog as G
from leafmill.plans.registry import query
from leafmill.sources.tables import RECORD_FIELDS, edit_log, elements, event_key, record_log, table

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
LOG = f"""log AS (SELECT user_id AS session, ts, event_id, CASE event_type WHEN 'click' THEN 'ADD' WHEN 'view' THEN 'UPDATE' WHEN 'purchase' THEN 'DELETE' WHEN 'signup' THEN 'CLEAR_PAGE' WHEN 'error' THEN 'UNDO' END AS action, 'el-' || ({K} % 10) AS element, {K} % 5 AS page_index, value FROM events)"""


def events(spark, sf):
    return table(spark, sf, "events")


def log(spark, sf):
    return edit_log(events(spark, sf))


@query(f"""WITH {LOG}, a AS (SELECT session, element, arg_max(page_index, (ts, event_id)) AS page_index, max((ts, event_id)) AS added FROM log WHERE action = 'ADD' GROUP BY ALL),
u AS (SELECT a.session, a.element, a.page_index, a.added, arg_max(l.value, (l.ts, l.event_id)) AS value FROM a JOIN log l ON a.session = l.session AND a.element = l.element AND l.action IN ('ADD', 'UPDATE') AND (l.ts, l.event_id) >= a.added GROUP BY ALL)
SELECT session, element, page_index, value FROM u WHERE NOT EXISTS (SELECT 1 FROM log d WHERE d.session = u.session AND d.action = 'DELETE' AND d.element = u.element AND (d.ts, d.event_id) > u.added) AND NOT EXISTS (SELECT 1 FROM log c WHERE c.session = u.session AND c.action = 'CLEAR_PAGE' AND c.page_index = u.page_index AND (c.ts, c.event_id) > u.added)""")
def fold_edits(spark, sf):
    return G.fold_edits(log(spark, sf))


RECORDS = f"""act AS (SELECT user_id AS session, (ts, event_id) AS moment, event_id, CASE event_type WHEN 'click' THEN 'ADD' WHEN 'view' THEN 'UPDATE' WHEN 'purchase' THEN 'DELETE' WHEN 'signup' THEN 'CLEAR_PAGE' END AS action, 'el-' || ({K} % 10) AS element, {K} AS k, value FROM events),
patch AS (SELECT session, element, moment, action = 'ADD' AS fresh, unnest(CASE WHEN action = 'ADD' THEN [{{'f': 'page_index', 'v': CAST(event_id % 5 AS VARCHAR)}}, {{'f': 'value', 'v': CAST(value AS VARCHAR)}}, {{'f': 'colour', 'v': ['red', 'green', 'blue'][k % 3 + 1]}}, {{'f': 'size', 'v': CASE WHEN event_id % 3 > 0 THEN CAST(k % 7 AS VARCHAR) END}}]
  WHEN event_id % 4 = 0 THEN [{{'f': 'value', 'v': CASE WHEN event_id % 5 > 0 THEN CAST(value AS VARCHAR) END}}] WHEN event_id % 4 = 1 THEN [{{'f': 'colour', 'v': CASE WHEN k % 2 = 1 THEN 'black' END}}] WHEN event_id % 4 = 2 THEN [{{'f': 'page_index', 'v': CAST(event_id % 5 AS VARCHAR)}}]
  ELSE [{{'f': 'size', 'v': CAST(k % 9 AS VARCHAR)}}, {{'f': 'value', 'v': CAST(value AS VARCHAR)}}] END) AS p FROM act WHERE action IN ('ADD', 'UPDATE')),
added AS (SELECT session, element, max(moment) AS added FROM act WHERE action = 'ADD' GROUP BY ALL),
life AS (SELECT session, element, moment, p.f AS f, p.v AS v, lead(moment) OVER (PARTITION BY session, element, p.f ORDER BY moment) AS until FROM patch JOIN added USING (session, element) WHERE moment >= added),
gone AS (SELECT a.session, a.element FROM added a JOIN act d ON d.session = a.session AND d.action = 'DELETE' AND d.element = a.element AND d.moment > a.added
  UNION SELECT l.session, l.element FROM life l JOIN act c ON c.session = l.session AND c.action = 'CLEAR_PAGE' AND l.f = 'page_index' AND CAST(c.k % 5 AS VARCHAR) = l.v AND c.moment > l.moment AND (l.until IS NULL OR c.moment < l.until))"""


@query(f"""WITH {RECORDS} SELECT session, element, max(v) FILTER (f = 'page_index') AS page_index, CAST(max(v) FILTER (f = 'value') AS DOUBLE) AS value, max(v) FILTER (f = 'colour') AS colour, max(v) FILTER (f = 'size') AS size
FROM life WHERE until IS NULL AND (session, element) NOT IN (SELECT (session, element) FROM gone) GROUP BY ALL""")
def fold_records(spark, sf):
    return typed(G.fold_records(record_log(events(spark, sf)), RECORD_FIELDS))


def typed(records):
    return records.withColumn("value", F.col("value").cast("double"))


@query(f"""WITH RECURSIVE {LOG}, l AS (SELECT session, event_id, action = 'UNDO' AS undo, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS n FROM log),
r AS (SELECT session, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS stack, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS undoes, false AS noop FROM (SELECT DISTINCT session FROM l)
  UNION ALL SELECT r.session, l.n, CASE WHEN l.undo THEN stack[1:len(stack) - 1] ELSE list_append(stack, l.event_id) END, l.event_id, CASE WHEN l.undo AND len(stack) > 0 THEN stack[len(stack)] END, l.undo AND len(stack) = 0 FROM r JOIN l ON l.session = r.session AND l.n = r.n + 1)
SELECT a.session, a.event_id, coalesce(b.event_id, -1) AS undone_by, a.noop FROM r a LEFT JOIN r b ON b.undoes = a.event_id WHERE a.n > 0""")
def undo_match(spark, sf):
    return G.undo_match(log(spark, sf)).withColumn("undone_by", F.coalesce("undone_by", F.lit(-1)))


REVERT = """e AS (SELECT DISTINCT 'el-' || l_orderkey || '-' || l_linenumber AS element, l_orderkey AS pos, CAST(l_linenumber AS DOUBLE) AS value FROM lineitem),
deleted AS (SELECT o_orderkey AS action_id, 'gone-' || o_orderkey AS element, o_totalprice AS value FROM orders WHERE o_orderkey % 3 = 0),
made AS (SELECT o_orderkey AS action_id, 'el-' || o_orderkey || '-1' AS element FROM orders WHERE o_orderkey % 3 <> 0)"""


def revert_inputs(spark, sf):
    own = elements(table(spark, sf, "lineitem")).select(F.col("id").alias("element"), F.col("doc").alias("pos"), (F.col("page_index") + 1).cast("double").alias("value")).distinct()
    key = F.col("o_orderkey")
    snapshot = F.when(key % 3 == 0, F.array(F.struct(F.concat(F.lit("gone-"), key.cast("string")).alias("element"), F.col("o_totalprice").alias("value"))))
    orders = table(spark, sf, "orders")
    actions = orders.select(key.alias("action_id"), F.concat(F.lit("el-"), key.cast("string"), F.lit("-1")).alias("element"), snapshot.alias("snapshot"))
    return own, actions, orders.where(key % 2 == 0).select(key.alias("action_id"))


@query(f"""WITH {REVERT} SELECT element, value FROM e WHERE element NOT IN (SELECT element FROM made WHERE action_id % 2 = 0) UNION ALL SELECT element, value FROM deleted WHERE action_id % 2 = 0""")
def revert_selected(spark, sf):
    return G.revert_selected(*revert_inputs(spark, sf))[0].select("element", "value")


@query(f"WITH {REVERT} SELECT o_orderkey AS action_id, 'el-' || o_orderkey || '-1' AS element FROM orders WHERE o_orderkey % 2 <> 0")
def revert_selected_log(spark, sf):
    return G.revert_selected(*revert_inputs(spark, sf))[1].select("action_id", "element")


@query(f"WITH {LOG} SELECT * FROM (SELECT session, event_id, action, element, row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) AS rank FROM log) WHERE rank <= 20")
def action_feed(spark, sf):
    return G.action_feed(log(spark, sf), 20).select("session", "event_id", "action", "element", "rank")


@query("SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events WHERE event_type = 'purchase') WHERE rank <= 10")
def recent_top10(spark, sf):
    return G.recent_top10(events(spark, sf).where("event_type = 'purchase'"), "user_id").select("user_id", "event_id", "rank")


@query("SELECT CAST(coalesce(max(CAST(substr(id, 4) AS BIGINT)), -1) + 1 AS BIGINT) AS next_id FROM (SELECT CASE WHEN l_linenumber = 1 THEN 'el-' || l_orderkey ELSE 'el-x' || l_orderkey END AS id FROM lineitem) WHERE regexp_matches(id, '^el-\\d+$')")
def id_seed(spark, sf):
    key = F.col("l_orderkey").cast("string")
    return G.id_seed(table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") == 1, F.concat(F.lit("el-"), key)).otherwise(F.concat(F.lit("el-x"), key)).alias("id"))).select(F.col("next_id").cast("long"))


@query("SELECT o_orderkey, 'el-' || (row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 100) AS id FROM orders")
def assign_ids(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return G.assign_ids(rows, 101, [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "id")


DRAFTS = "drafts AS (SELECT user_id AS key, CASE WHEN event_id % 11 > 0 THEN ts END AS saved_at, value AS payload, event_type = 'error' AS deleted, event_id AS seq FROM events)"
LATEST = DRAFTS + ", latest AS (SELECT key, saved_at, payload FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY saved_at DESC NULLS LAST, seq DESC) AS n FROM drafts) WHERE n = 1 AND NOT deleted)"


def drafts(spark, sf):
    return drafts_of(events(spark, sf))


def drafts_of(rows, *more):
    return rows.select(*more, F.col("user_id").alias("key"), F.when(F.col("event_id") % 11 > 0, F.col("ts")).alias("saved_at"), F.col("value").alias("payload"), (F.col("event_type") == "error").alias("deleted"), F.col("event_id").alias("seq"))


def moment(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query(f"WITH {LATEST} SELECT * FROM latest")
def latest_draft(spark, sf):
    return H.latest_draft(drafts(spark, sf))


@query(f"WITH {DRAFTS} SELECT key, seq, saved_at, coalesce(saved_at + INTERVAL 14 DAY > TIMESTAMP '2024-01-20', false) AS live FROM drafts")
def expire_drafts(spark, sf):
    return H.expire_drafts(drafts(spark, sf), moment("2024-01-20 00:00:00")).select("key", "seq", "saved_at", "live")


HANDOFFS = "h AS (SELECT user_id AS key, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'save' ELSE 'take' END AS kind, CASE WHEN event_id % 7 > 0 THEN value END AS payload FROM events WHERE event_type IN ('signup', 'purchase'))"


def handoffs(spark, sf):
    return events(spark, sf).where("event_type in ('signup', 'purchase')").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "save").otherwise("take").alias("kind"), F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("payload"))


@query(f"""WITH {HANDOFFS}, t AS (SELECT *, lag((ts, seq)) OVER (PARTITION BY key ORDER BY ts, seq) AS prev FROM h WHERE kind = 'take'),
j AS (SELECT t.key, t.ts AS take_ts, t.seq, arg_max((s.ts, s.payload), (s.ts, s.seq)) AS s FROM t LEFT JOIN h s ON s.key = t.key AND s.kind = 'save' AND (s.ts, s.seq) < (t.ts, t.seq) AND (t.prev IS NULL OR (s.ts, s.seq) > t.prev) GROUP BY ALL),
k AS (SELECT key, take_ts, seq, s[1] AS save_ts, s[2] AS payload, CASE WHEN s[1] IS NULL THEN 'empty' WHEN take_ts - INTERVAL 6 HOUR > s[1] THEN 'expired' WHEN s[2] IS NULL THEN 'empty' ELSE 'ok' END AS status FROM j)
SELECT key, take_ts, seq, save_ts, CASE WHEN status = 'ok' THEN payload END AS payload, status FROM k""")
def take_handoff(spark, sf):
    return H.take_handoff(handoffs(spark, sf), "interval 6 hours")


def edits(spark, sf):
    return events(spark, sf).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("payload"), F.when(F.col("event_type") == "error", "idle").otherwise("editing").alias("status"))


BURSTS = """b AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR, true) AS fresh FROM events WHERE event_type <> 'error'))"""


@query(f"WITH {BURSTS} SELECT user_id AS key, CAST(min(ts) AS TIMESTAMP) AS burst_start, CAST(max(ts) + INTERVAL 2 HOUR AS TIMESTAMP) AS burst_end, arg_max(value, (ts, event_id)) AS payload FROM b GROUP BY user_id, burst")
def debounce_saves(spark, sf):
    found = H.debounce_saves(edits(spark, sf), "2 hours")
    return found.withColumn("burst_start", F.col("burst_start").cast("timestamp_ntz")).withColumn("burst_end", F.col("burst_end").cast("timestamp_ntz"))


@query(f"""SELECT slot, arg_min(claimant, (ts, priority, event_id)) AS claimant, min(ts) AS ts FROM (SELECT {K} AS slot, CASE event_type WHEN 'click' THEN 'manual' WHEN 'signup' THEN 'handoff' ELSE 'draft' END AS claimant, CASE event_type WHEN 'click' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS priority, date_trunc('hour', ts) AS ts, event_id FROM events) GROUP BY slot""")
def first_claim(spark, sf):
    who = F.when(F.col("event_type") == "click", F.struct(F.lit(0).alias("p"), F.lit("manual").alias("c"))).when(F.col("event_type") == "signup", F.struct(F.lit(1).alias("p"), F.lit("handoff").alias("c"))).otherwise(F.struct(F.lit(2).alias("p"), F.lit("draft").alias("c")))
    rows = events(spark, sf).withColumn("who", who)
    return H.first_claim(rows.select(event_key(rows).alias("slot"), "who.c", "who.p", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("seq")).withColumnsRenamed({"c": "claimant", "p": "priority"}))


@query(f"SELECT user_id AS slot, {K} AS generation, event_id AS seq, {K} = max({K}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS kept FROM events")
def drop_superseded(spark, sf):
    rows = events(spark, sf)
    return H.drop_superseded(rows.select(F.col("user_id").alias("slot"), event_key(rows).alias("generation"), "ts", F.col("event_id").alias("seq"))).select("slot", "generation", "seq", "kept")


@query(f"SELECT user_id || '-' || {K} AS gesture, arg_max(value, (ts, event_id)) AS patch, max(ts) AS ts FROM events GROUP BY 1")
def commit_once(spark, sf):
    rows = events(spark, sf)
    return H.commit_once(rows.select(F.concat_ws("-", F.col("user_id").cast("string"), event_key(rows).cast("string")).alias("gesture"), F.col("value").alias("patch"), "ts", F.col("event_id").alias("seq")))


@query("WITH t AS (SELECT event_type AS tool, max(CASE WHEN event_type <> 'error' THEN ts END) AS saved_at FROM events GROUP BY 1), r(tool, title) AS (VALUES ('click', 'Click'), ('view', 'View'), ('error', 'Error'), ('sign', 'Sign')) SELECT tool, title, saved_at, row_number() OVER (ORDER BY saved_at DESC NULLS LAST, tool) AS rank FROM t JOIN r USING (tool)")
def resume_list(spark, sf):
    live = events(spark, sf).groupBy(F.col("event_type").alias("tool")).agg(F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("saved_at"))
    return H.resume_list(live, spark.createDataFrame([(t, t.title()) for t in ("click", "view", "error", "sign")], "tool string, title string"))


@query(f"""WITH {LATEST}, hints AS (SELECT DISTINCT user_id AS key FROM events WHERE event_type = 'view' AND user_id % 3 > 0)
SELECT key, CASE WHEN d.k IS NULL THEN 'stale_hint' WHEN NOT coalesce(saved_at + INTERVAL 14 DAY > TIMESTAMP '2024-02-12', false) THEN 'expired' WHEN h.k IS NULL THEN 'missing_hint' ELSE 'ok' END AS state
FROM (SELECT key, key AS k, saved_at FROM latest) d FULL JOIN (SELECT key, key AS k FROM hints) h USING (key)""")
def hint_reconcile(spark, sf):
    hints = events(spark, sf).where("event_type = 'view' and user_id % 3 > 0").select(F.col("user_id").alias("key")).distinct()
    return H.hint_reconcile(hints, H.latest_draft(drafts(spark, sf)), moment("2024-02-12 00:00:00"))


@query("SELECT r.user_id AS key, r.ts, r.event_id AS seq FROM events r WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.user_id = r.user_id AND c.ts BETWEEN r.ts AND r.ts + INTERVAL 6 HOUR)")
def request_timeouts(spark, sf):
    rows = events(spark, sf).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), "event_type")
    return H.request_timeouts(rows.where("event_type = 'view'"), rows.where("event_type = 'click'"), "interval 6 hours")


@query(f"""WITH v AS (SELECT user_id AS session, ts, event_id AS seq, {K} AS page, value / 491 - CAST(0.2 AS DOUBLE) AS ratio FROM events),
known AS (SELECT a.session, a.ts, a.seq, b.page, arg_max(b.ratio, (b.ts, b.seq)) AS ratio FROM v a JOIN v b ON b.session = a.session AND (b.ts, b.seq) <= (a.ts, a.seq) GROUP BY ALL)
SELECT session, ts, seq, CAST(CASE WHEN max(ratio) > 0 THEN arg_max(page, (ratio, -page)) ELSE 0 END AS INTEGER) AS page FROM known GROUP BY ALL""")
def current_page(spark, sf):
    rows = events(spark, sf)
    return H.current_page(rows.select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"), event_key(rows).alias("page"), (F.col("value") / 491 - 0.2).alias("ratio")))
