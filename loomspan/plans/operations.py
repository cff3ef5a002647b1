"""Registered queries on events, faults and policies, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import events as ev
from ..operators import manifest
from .retrieval import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


def events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("second", F.unix_seconds("ts"))


E = "e AS (SELECT *, floor(epoch(ts))::BIGINT AS second FROM events)"


@query("A5_stage_totals", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def a5(spark, sf_dir):
    """Events per run and stage."""
    return ev.stage_totals(events(spark, sf_dir), "user_id", "event_type")


@query("A9_fault_summary", f"""WITH f AS (SELECT event_id AS fault_id, ts, (user_id % 4 + 1)::INT AS severity, 'C' || (event_id % 3) AS error_class, event_id % 5 = 0 AS resolved FROM events WHERE event_type = 'error')
SELECT severity, error_class, count(*) AS n, count(*) FILTER (NOT resolved) AS unresolved, arg_max(fault_id, (ts, fault_id)) AS latest FROM f GROUP BY GROUPING SETS ((severity), (error_class), ())""")
def a9(spark, sf_dir):
    """Faults by severity, by class and in all."""
    e = events(spark, sf_dir).where("event_type = 'error'")
    return ev.fault_summary(e.select(F.col("event_id").alias("fault_id"), "ts", (F.col("user_id") % 4 + 1).cast("int").alias("severity"), F.concat(F.lit("C"), F.col("event_id") % 3).alias("error_class"), (F.col("event_id") % 5 == 0).alias("resolved")))


_MODE = "CASE page_id % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'online' WHEN 2 THEN 'offline' ELSE 'strange' END"
_POLICY = f"""h AS (SELECT page_id, {_MODE} AS mode, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM pages),
p AS (SELECT *, CASE WHEN mode = 'admin' THEN 'admin' WHEN mode = 'offline' THEN 'offline_blocked' WHEN mode = 'online' AND host = 'ththed.example.org' THEN 'host_listed' WHEN mode = 'online' AND starts_with(url, 'https://www.') THEN 'prefix_listed' WHEN mode = 'online' THEN 'not_listed' ELSE 'unknown_mode' END AS rule FROM h)"""


def _policy(spark, sf_dir):
    i = F.col("page_id") % 4
    mode = F.when(i == 0, "admin").when(i == 1, "online").when(i == 2, "offline").otherwise("strange")
    p = ev.url_policy(F.col("url"), mode, ["ththed.example.org"], ["https://www."])
    return table(spark, sf_dir, "pages").select("page_id", p.alias("p"), F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)).alias("host")).select("page_id", "host", "p.*")


@query("P7_url_policy", f"WITH {_POLICY} SELECT page_id, host, rule IN ('admin', 'host_listed', 'prefix_listed') AS allowed, rule FROM p")
def p7(spark, sf_dir):
    """Decision and rule for every page's URL."""
    return _policy(spark, sf_dir)


@query("A10_audit_summary", f"WITH {_POLICY} SELECT count(*) AS checks, count(*) FILTER (rule IN ('admin', 'host_listed', 'prefix_listed')) AS allowed, count(*) FILTER (rule NOT IN ('admin', 'host_listed', 'prefix_listed')) AS denied, list_sort(list(DISTINCT host)) AS hosts FROM p")
def a10(spark, sf_dir):
    """Access audit."""
    return ev.audit_summary(_policy(spark, sf_dir))


#: Parts of messages; every error event takes two, so that most rules are met, some by two parts together.
_PARTS = ("Request failed", "429", "memory", "error while loading", "yaml", "syntax is odd", "disk", "is full", "DNS lookup", "embedding", "a model", "nothing known", "audit log", "tamper", "api says 404", "could not parse", "pdf", "PII found", "credential", "401",
          "Forbidden", "connection refused", "SSL", "timed out", "503", "400 api", "sqlite", "mmap", "numpy", "SentenceTransformer", "CUDA", "encoding", "config", "missing", "No space left", "retrieval", "zero hits", "unauthorized access", "page two")
_KINDS = ("error", "TimeoutError", "PermissionError", "BadRequest", "OperationalError", "MemoryError", "error", "error", "error", "error", "error")


def fault_case(kind: str, message: str, what: int) -> str:
    """SQL of a fault's class (``what`` 0) or severity (1)."""
    fields = {"kind": kind, "text": message, "lower": f"lower({message})", "upper": f"upper({message})"}
    quoted = lambda x: "'" + x + "'" if isinstance(x, str) else str(x)
    when = lambda parts: " AND ".join(f"regexp_matches({fields[f]}, '(?s){pattern}')" for f, pattern in parts.items())
    cases = " ".join(f"WHEN {' OR '.join(f'({when(parts)})' for parts in rule[2])} THEN {quoted(rule[what])}" for rule in ev.FAULT_RULES)
    return f"CASE {cases} ELSE {quoted(ev.OTHER_FAULT[what])} END"


_FAULT_INPUT = f"""SELECT event_id, {list(_KINDS)}[event_id % {len(_KINDS)} + 1] AS kind, {list(_PARTS)}[event_id % {len(_PARTS)} + 1] || ' ' || {list(_PARTS)}[event_id * 7 // 3 % {len(_PARTS)} + 1] AS message FROM events WHERE event_type = 'error'"""


@query("P8_classify", f"WITH f AS ({_FAULT_INPUT}) SELECT event_id, {fault_case('kind', 'message', 0)} AS error_class, {fault_case('kind', 'message', 1)} AS severity FROM f")
def p8(spark, sf_dir):
    """Class and severity of every error event, with a type and a message made from its id."""
    pick = lambda names, k: F.get(F.array(*(F.lit(x) for x in names)), (k % len(names)).cast("int"))
    i = F.col("event_id")
    message = F.concat(pick(_PARTS, i), F.lit(" "), pick(_PARTS, F.floor(i * 7 / 3)))
    return events(spark, sf_dir).where("event_type = 'error'").select("event_id", ev.classify_fault(pick(_KINDS, i), message).alias("f")).select("event_id", "f.*")


@query("P9_http_error", "SELECT event_id, CASE s WHEN 401 THEN 'AuthRejected' WHEN 403 THEN 'Forbidden' WHEN 404 THEN 'DeploymentNotFound' WHEN 429 THEN 'RateLimited' ELSE CASE WHEN s BETWEEN 500 AND 599 THEN 'ServerError' ELSE 'API-' || s END END AS code, 'HTTP ' || s || ': ' || left(props, 300) AS message FROM (SELECT *, 400 + event_id % 120 AS s FROM events)")
def p9(spark, sf_dir):
    """Error code of every event taken as a response."""
    return events(spark, sf_dir).select("event_id", ev.http_error(F.col("event_id") % 120 + 400, F.col("props")).alias("e")).select("event_id", "e.*")


@query("A13_metric_stats", "SELECT event_type, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stdev, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def a13(spark, sf_dir):
    """Statistics of the value per stage."""
    return ev.metric_stats(events(spark, sf_dir), "event_type", "value")


@query("A14_traffic_profile", "WITH l AS (SELECT 'event_type' AS dim, event_type AS value FROM events UNION ALL SELECT 'user_id', user_id::VARCHAR FROM events), c AS (SELECT dim, value, count(*) AS n FROM l GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY n DESC, value) AS rank FROM c) WHERE rank <= 10")
def a14(spark, sf_dir):
    """The ten most common values of each dimension."""
    return ev.top_values(events(spark, sf_dir), ["event_type", "user_id"])


@query("A14_profile_times", """WITH l AS (SELECT 'event_type' AS dim, event_type AS value, ts FROM events UNION ALL SELECT 'user_id', user_id::VARCHAR, ts FROM events), c AS (SELECT dim, value, count(*) AS n, min(ts) AS first, max(ts) AS last FROM l GROUP BY ALL)
SELECT dim, value, n, first, last, rank FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY n DESC, value) AS rank FROM c) WHERE rank <= 10 UNION ALL SELECT 'all', NULL, count(*), min(ts), max(ts), 1 FROM events""")
def a14_times(spark, sf_dir):
    """The most common values with their first and last time, and the whole table's."""
    return ev.profile(table(spark, sf_dir, "events"), ["event_type", "user_id"])


@query("A16_status_counts", "SELECT count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view FROM events")
def a16(spark, sf_dir):
    """Events by status, pivoted."""
    return events(spark, sf_dir).groupBy().pivot("event_type", ["click", "error", "purchase", "signup", "view"]).count()


@query("A18_cost_by_day", "WITH c AS (SELECT ts::DATE AS day, event_type AS key, sum(value) AS c FROM events GROUP BY ALL) SELECT day::VARCHAR AS day, key, round(c, 4) AS cost, sum(c) OVER (PARTITION BY day) > 1000 AS over_budget FROM c")
def a18(spark, sf_dir):
    """Daily cost by key against a budget."""
    return ev.cost_by_day(events(spark, sf_dir).select("ts", F.col("event_type").alias("key"), F.col("value").alias("cost")), 1000.0).withColumn("day", F.col("day").cast("string"))


@query("J8_traces", f"WITH {E} SELECT f.event_id AS fault_id, e.event_id FROM e f JOIN e ON abs(e.second - f.second) <= 60 WHERE f.event_type = 'error' AND f.event_id % 10 = 0")
def j8(spark, sf_dir):
    """Events within a minute of every tenth fault, as the report asks."""
    e = events(spark, sf_dir)
    faults = e.where("event_type = 'error' AND event_id % 10 = 0").select(F.col("event_id").alias("fault_id"), F.col("second").alias("fault_second"))
    return ev.traces(e.select("event_id", "second"), faults, 60)


@query("J8_traces_all", ORACLE["J8_traces"].replace(" AND f.event_id % 10 = 0", ""))
def j8_all(spark, sf_dir):
    """Events within a minute of every fault."""
    e = events(spark, sf_dir)
    return ev.traces(e.select("event_id", "second"), e.where("event_type = 'error'").select(F.col("event_id").alias("fault_id"), F.col("second").alias("fault_second")), 60)


@query("W4_rolling_speed", f"WITH {E} SELECT event_id, round(sum(value) OVER w / greatest((second - min(second) OVER w)::DOUBLE, 0.1), 6) AS speed FROM e WINDOW w AS (PARTITION BY user_id ORDER BY second RANGE BETWEEN 30 PRECEDING AND CURRENT ROW)")
def w4(spark, sf_dir):
    """Rolling speed of each run."""
    return ev.rolling_speed(events(spark, sf_dir), "user_id").select("event_id", "speed")


@query("W5_running_eta", f"WITH {E}, r AS (SELECT event_id, count(*) OVER w AS done, count(*) OVER w / nullif(second - min(second) OVER w, 0) AS rate FROM e WINDOW w AS (PARTITION BY user_id ORDER BY second, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, done, round((1000 - done) / rate, 6) AS eta, round(rate, 6) AS rate FROM r")
def w5(spark, sf_dir):
    """Progress and time left of each run."""
    return ev.running_eta(events(spark, sf_dir), "user_id", F.lit(1000)).select("event_id", "done", "rate", "eta")


@query("W6_ema", f"""WITH RECURSIVE {E}, o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY second, event_id) AS k FROM e),
w AS (SELECT user_id, k, value::DOUBLE AS ema FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, 0.25::DOUBLE * o.value + 0.75::DOUBLE * w.ema FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
SELECT user_id, round(arg_max(ema, k), 6) AS ema FROM w GROUP BY user_id""")
def w6(spark, sf_dir):
    """Exponential moving average of each run."""
    return ev.ema(events(spark, sf_dir), "user_id")


@query("W6_eta", f"""WITH RECURSIVE {E}, o AS (SELECT *, row_number() OVER w AS k, second - lag(second) OVER w AS dt, sum(value) OVER (PARTITION BY user_id ORDER BY second, event_id ROWS UNBOUNDED PRECEDING) AS done FROM e WINDOW w AS (PARTITION BY user_id ORDER BY second, event_id)),
i AS (SELECT *, value / greatest(dt, 0.001::DOUBLE) AS now FROM o),
w AS (SELECT user_id, k, event_id, done, NULL::DOUBLE AS rate FROM i WHERE k = 1 UNION ALL SELECT i.user_id, i.k, i.event_id, i.done, CASE WHEN w.rate IS NULL THEN i.now ELSE 0.25::DOUBLE * i.now + 0.75::DOUBLE * w.rate END FROM w JOIN i ON i.user_id = w.user_id AND i.k = w.k + 1)
SELECT event_id, round(done, 4) AS done, round(rate, 6) AS rate, round(CASE WHEN rate > 1e-6 THEN greatest(10000 - done, 0) / rate END, 4) AS eta FROM w""")
def w6_eta(spark, sf_dir):
    """Time left of each run at every sample, at the smoothed rate."""
    e = events(spark, sf_dir).select("user_id", "second", "event_id", "value")
    return ev.smoothed_eta(e, "user_id", F.lit(10000.0)).select("event_id", F.round("done", 4).alias("done"), F.round("rate", 6).alias("rate"), F.round("eta", 4).alias("eta"))


@query("W7_last_events", f"WITH {E} SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY second DESC, event_id DESC) AS rank FROM e) WHERE rank <= 15")
def w7(spark, sf_dir):
    """The last 15 events of each run."""
    return ev.last_n(events(spark, sf_dir), "user_id", 15).select("user_id", "event_id", "rank")


@query("W10_fault_state", "SELECT user_id AS fault_id, arg_max(event_type = 'purchase', (ts, event_id)) AS resolved FROM events GROUP BY user_id")
def w10(spark, sf_dir):
    """Resolved flag by each fault's last event."""
    return ev.fault_state(events(spark, sf_dir).select(F.col("user_id").alias("fault_id"), "ts", "event_id", (F.col("event_type") == "purchase").alias("resolved")))


@query("S13_run_log", f"WITH {E} SELECT user_id AS run_id, min(ts) AS started, arg_max(event_type, (ts, event_type)) AS status, floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT AS seconds, count(*) AS files FROM e GROUP BY user_id")
def s13(spark, sf_dir):
    """One row per run folded from its events."""
    log = events(spark, sf_dir).select(F.col("user_id").alias("run_id"), "ts", F.col("event_type").alias("status"), F.lit(1).cast("long").alias("files"))
    return manifest.run_log(log).withColumn("started", F.col("started").cast("timestamp_ntz"))


@query("W3_previous_run", "WITH r AS (SELECT user_id AS run_id, min(ts) AS started, CASE WHEN user_id % 3 = 0 THEN 'failed' ELSE 'completed' END AS status FROM events GROUP BY user_id) SELECT run_id, last_value(CASE WHEN status = 'completed' THEN run_id END IGNORE NULLS) OVER (ORDER BY started, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM r")
def w3(spark, sf_dir):
    """The completed run before each run."""
    runs = events(spark, sf_dir).groupBy(F.col("user_id").alias("run_id")).agg(F.min("ts").alias("started")).withColumn("status", F.when(F.col("run_id") % 3 == 0, "failed").otherwise("completed"))
    return manifest.previous_completed(runs).select("run_id", "previous")


_XML = "'<Event><System><Provider Name=\"' || event_type || '\"/><EventID>' || event_id || '</EventID><TimeCreated SystemTime=\"' || user_id || '\"/></System><EventData><Data Name=\"k\">' || props || '</Data><Data>x</Data></EventData></Event>'"


@query("S14_event_xml", "SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS time, event_type AS provider, [props, 'x'] AS data, user_id || ' ' || event_id || ' ' || event_type || ' ' || props || ' | x' AS line FROM events")
def s14(spark, sf_dir):
    """Fields of event-log XML made from the events."""
    xml = F.concat(F.lit('<Event><System><Provider Name="'), "event_type", F.lit('"/><EventID>'), F.col("event_id"), F.lit('</EventID><TimeCreated SystemTime="'), F.col("user_id"), F.lit('"/></System><EventData><Data Name="k">'), "props", F.lit("</Data><Data>x</Data></EventData></Event>"))
    return events(spark, sf_dir).select(ev.event_xml_fields(xml).alias("x")).select("x.*")


@query("F10_details", "SELECT event_id, 'k=' || json_extract_string(props, '$.k') AS details FROM events")
def f10(spark, sf_dir):
    """JSON details as lines."""
    return events(spark, sf_dir).select("event_id", ev.details_lines(F.from_json("props", "map<string,string>")).alias("details"))


@query("F3_human_size", "SELECT event_id, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f KB', s / 1024) WHEN s < 1073741824 THEN printf('%.1f MB', s / 1048576) ELSE printf('%.1f GB', s / 1073741824) END AS size, CASE WHEN event_id < 60 THEN event_id || 's' WHEN event_id < 3600 THEN (event_id // 60) || 'm ' || (event_id % 60) || 's' ELSE (event_id // 3600) || 'h ' || (event_id // 60 % 60) || 'm' END AS duration FROM (SELECT event_id, event_id * 7919 AS s FROM events)")
def f3(spark, sf_dir):
    """Sizes and durations for people."""
    return events(spark, sf_dir).select("event_id", fn.human_size(F.col("event_id") * 7919).alias("size"), fn.human_duration(F.col("event_id")).alias("duration"))


@query("F7_tolerant_times", "SELECT event_id, try_cast(CASE WHEN event_id % 4 = 0 THEN 'no time' ELSE ts::VARCHAR END AS TIMESTAMP) AS parsed FROM events")
def f7(spark, sf_dir):
    """Times parsed where they can be."""
    told = F.when(F.col("event_id") % 4 == 0, "no time").otherwise(F.col("ts").cast("string"))
    return events(spark, sf_dir).select("event_id", F.try_to_timestamp(told).cast("timestamp_ntz").alias("parsed"))
