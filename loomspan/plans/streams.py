"""Registered queries that drain a stream of the given tables, and extraction, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate
from ..session import sized
from ..sources import files
from ..streaming import jobs
from .operations import fault_case
from .retrieval import shared_path, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


def _fed(spark, sf_dir, root, closing=False):
    """Writes the events to ``root/in`` in time order, a quarter at a time, and yields after each.

    Events without a time come first. Each quarter is written by as many tasks as
    its scan has. ``closing`` adds a last event of user -1, long after all others.
    """
    told = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    cuts = told.agg(F.percentile_approx("at", [0.25, 0.5, 0.75], 1000)).first()[0] or []
    for k in range(len(cuts) + 1):
        low = F.col("at") > cuts[k - 1] if k else F.lit(True)
        high = (F.col("at") <= cuts[k]) if k < len(cuts) else F.lit(True)
        now = (low & high) | F.col("at").isNull() if not k else low & high
        told.where(now).drop("at").write.mode("append").parquet(f"{root}/in")
        yield
    if closing:
        end = spark.sql("SELECT -1L AS event_id, timestamp_ntz'2200-01-01' AS ts, -1L AS user_id, 'end' AS event_type, 0D AS value, '' AS props")
        end.write.mode("append").parquet(f"{root}/in")
        yield


def _drained(spark, sf_dir, job, mode, closing=False):
    """Feeds the events (``_fed``), each time to a query that goes on from the last one's checkpoint, and returns all that the job gave out, from a table in the shared folder."""
    root = shared_path(spark, "stream")
    for _ in _fed(spark, sf_dir, root, closing):
        out = job(jobs.event_stream(spark, f"{root}/in", files_per_batch=1 << 30))
        jobs.drain(out, "", f"{root}/checkpoint", mode, lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{root}/out"))
    return spark.read.parquet(f"{root}/out")


def _latest(df, keys, value):
    return df.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


@query("ST2_once", "SELECT event_id, event_type FROM events")
def st2(spark, sf_dir):
    """Every event once, from a stream that has each twice."""
    return _drained(spark, sf_dir, lambda s: jobs.once(s.union(s), late="60 days"), "append").select("event_id", "event_type")


@query("ST3_stage_counts", "SELECT date_trunc('hour', ts)::VARCHAR AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st3(spark, sf_dir):
    """Hourly counts per event type, after the drain."""
    df = _latest(_drained(spark, sf_dir, lambda s: jobs.stage_counts(s, late="60 days"), "update"), ["start", "event_type"], "n")
    return df.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("ST4_sliding_speed", "SELECT strftime(to_timestamp((floor(epoch(ts) / 10) - k) * 10)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS start, round(sum(value), 6) AS total FROM events, (VALUES (0), (1), (2)) w(k) GROUP BY 1")
def st4(spark, sf_dir):
    """Value in sliding windows of 30 seconds, after the drain."""
    df = _latest(_drained(spark, sf_dir, lambda s: jobs.sliding_speed(s, late="60 days"), "update"), ["start"], "total")
    return df.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "total")


@query("ST6_ema", """WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, k, value::DOUBLE AS ema FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, 0.25::DOUBLE * o.value + 0.75::DOUBLE * w.ema FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
SELECT user_id, round(arg_max(ema, k), 6) AS ema FROM w GROUP BY user_id""")
def st6(spark, sf_dir):
    """Stateful moving average of each run, after the drain."""
    df = _latest(_drained(spark, sf_dir, lambda s: jobs.ema_rate(s, late="60 days"), "update"), ["user_id"], "ema")
    return df.withColumn("ema", F.round("ema", 6))


@query("ST6_eta", """WITH RECURSIVE o AS (SELECT user_id, value, floor(epoch(ts)) - lag(floor(epoch(ts))) OVER w AS dt, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
w AS (SELECT user_id, k, value::DOUBLE AS done, NULL::DOUBLE AS rate FROM o WHERE k = 1 UNION ALL
  SELECT o.user_id, o.k, w.done + o.value, CASE WHEN w.rate IS NULL THEN o.value / greatest(o.dt, 0.001::DOUBLE) ELSE 0.25::DOUBLE * o.value / greatest(o.dt, 0.001::DOUBLE) + 0.75::DOUBLE * w.rate END FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1),
l AS (SELECT user_id, arg_max(done, k) AS done, arg_max(struct_pack(r := rate), k).r AS rate FROM w GROUP BY user_id)
SELECT user_id, round(done, 4) AS done, round(rate, 6) AS rate, round(CASE WHEN rate > 1e-6 THEN greatest(10000 - done, 0) / rate END, 4) AS eta FROM l""")
def st6_eta(spark, sf_dir):
    """Progress and time left of each run, given out when its state has expired."""
    df = _drained(spark, sf_dir, lambda s: jobs.ema_rate(s, total=10000.0, late="60 days"), "update", closing=True)
    return df.where("ended").select("user_id", F.round("done", 4).alias("done"), F.round("rate", 6).alias("rate"), F.round("eta", 4).alias("eta"))


@query("ST5_flight_log", "SELECT user_id, event_id, event_type, ceil(count(*) OVER (PARTITION BY user_id) / 100.0)::BIGINT AS least_blocks FROM events")
def st5_log(spark, sf_dir):
    """Every event once from the append-only log, over restarts, and in how many blocks a user's events fit."""
    root = shared_path(spark, "flight")
    with jobs.state_store(spark):
        for _ in _fed(spark, sf_dir, root, closing=True):
            log = jobs.flight_log(jobs.event_stream(spark, f"{root}/in", files_per_batch=1 << 30), late="60 days")
            files.write_records(log, f"{root}/log", f"{root}/checkpoint")
    log = spark.read.schema(log.schema).json(f"{root}/log").where("user_id <> -1")
    blocks = log.groupBy("user_id").agg((F.max("block") + 1).alias("least_blocks"))  # no more than needed: only the last is short
    return log.join(blocks.hint("merge"), "user_id").select("user_id", "event_id", "event_type", "least_blocks")


@query("ST5_recent_state", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 50")
def st5_state(spark, sf_dir):
    """The last 50 events of each user, read from the state that the log's stream keeps."""
    root = shared_path(spark, "flight")
    with jobs.state_store(spark):
        for _ in _fed(spark, sf_dir, root):
            log = jobs.flight_log(jobs.event_stream(spark, f"{root}/in", files_per_batch=1 << 30), n=50, late="60 days")
            files.write_records(log, f"{root}/log", f"{root}/checkpoint")
        return jobs.kept_state(spark, f"{root}/checkpoint", "recent").select("user_id", "event_id")


@query("ST5_last_events", "WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS events FROM r WHERE k <= 20 GROUP BY user_id")
def st5(spark, sf_dir):
    """The last 20 events of each run, kept in state."""
    df = _latest(_drained(spark, sf_dir, lambda s: jobs.last_events(s, 20), "update"), ["user_id"], "events")
    return df.select("user_id", F.array_join(F.col("events").cast("array<string>"), ",").alias("events"))


PLAYBOOK = (("INTERNAL_ERROR", "look at the log"), ("AUTH_ERROR", "check the key"), ("API_ERROR", "try again later"))


@query("ST7_faults", f"""WITH f AS (SELECT event_id, event_type AS kind, props AS message FROM events WHERE event_type = 'error'),
k AS (SELECT event_id, {fault_case('kind', 'message', 0)} AS error_class, {fault_case('kind', 'message', 1)} AS severity FROM f)
SELECT event_id, error_class, severity, advice FROM k LEFT JOIN (VALUES {", ".join(f"('{c}', '{a}')" for c, a in PLAYBOOK)}) p(error_class, advice) USING (error_class)""")
def st7(spark, sf_dir):
    """Every error event classified and joined with a playbook."""
    playbook = spark.createDataFrame(PLAYBOOK, "error_class string, advice string")
    return _drained(spark, sf_dir, lambda s: jobs.faults(s, playbook), "append").select("event_id", "error_class", "severity", "advice")


QUERIES["ST7_faults_all"], ORACLE["ST7_faults_all"] = st7, ORACLE["ST7_faults"]


@query("ST9_traces", "SELECT f.event_id AS fault_id, e.event_id FROM events f JOIN events e ON e.ts BETWEEN f.ts - INTERVAL 60 SECOND AND f.ts + INTERVAL 60 SECOND WHERE f.event_type = 'error' AND f.event_id % 10 = 0")
def st9(spark, sf_dir):
    """Events within a minute of every tenth fault, by a stream-stream join."""
    return _drained(spark, sf_dir, lambda s: jobs.traced(s, s.where("event_type = 'error' AND event_id % 10 = 0"), late="60 days"), "append").select("fault_id", "event_id")


@query("ST9_traces_all", ORACLE["ST9_traces"].replace(" AND f.event_id % 10 = 0", ""))
def st9_all(spark, sf_dir):
    """Events within a minute of every fault, by a stream-stream join."""
    return _drained(spark, sf_dir, lambda s: jobs.traced(s, s.where("event_type = 'error'"), late="60 days"), "append").select("fault_id", "event_id")


@query("S3_extract_html")
def s3(spark, sf_dir):
    """Visible text, title and sizes of every page."""
    return files.extract_html(table(spark, sf_dir, "pages")).select("page_id", "text", "title", "html_length", "text_length", F.round("compression_ratio", 6).alias("compression_ratio"), "error")


@query("S5_parse_mail", """WITH m AS (SELECT doc_id, source, text, 'From: a@example.org' || chr(10) || 'Subject: ' || source || chr(10) || 'Content-Type: text/plain; charset=utf-8' || chr(10) || 'Content-Transfer-Encoding: 8bit' || chr(10) || chr(10) || text AS mail FROM documents)
SELECT doc_id::VARCHAR AS path, source AS subject, length(text)::INT AS chars, 0 AS attachments, sha1(mail) AS sha1, 'ok' AS status FROM m""")
def s5(spark, sf_dir):
    """Every document wrapped as a mail message and parsed."""
    d = table(spark, sf_dir, "documents")
    content = F.concat(F.lit("From: a@example.org\nSubject: "), "source", F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), "text").cast("binary")
    return files.parse_mail(d.select(F.col("doc_id").cast("string").alias("path"), content.alias("content"))).select("path", "subject", F.char_length("body").alias("chars"), "attachments", "sha1", "status")


@query("ST8_progress", "SELECT count(*) AS rows, count(*) FILTER (event_type = 'error') AS errors, count(*) AS listened FROM events")
def st8(spark, sf_dir):
    """Live counters of a batch job, and the rows that a listener saw a stream read, against the table's."""
    counted, watch = jobs.observed(table(spark, sf_dir, "events"), "progress", rows=F.count("*"), errors=F.count_if(F.col("event_type") == "error"))
    root = shared_path(spark, "progress")
    counted.write.parquet(f"{root}/in")
    heard = jobs.Progress()
    spark.streams.addListener(heard)
    try:
        query = jobs.drain(jobs.event_stream(spark, f"{root}/in"), "", f"{root}/checkpoint", sink=lambda batch, n: batch.write.mode("append").parquet(f"{root}/out"))
        heard.wait(str(query.runId))
    finally:
        spark.streams.removeListener(heard)
    return spark.createDataFrame([(watch.get["rows"], watch.get["errors"], heard.rows)], "rows long, errors long, listened long")


@query("ST10_late_rows", "WITH t AS (SELECT max(ts) AS last FROM events) SELECT count(*) FILTER (e.ts < last - INTERVAL 10 DAY) AS dropped FROM events e, t")
def st10(spark, sf_dir):
    """Events that come again after the watermark has passed them, as the stream's own metric counts them."""
    root = shared_path(spark, "late")
    told = table(spark, sf_dir, "events")
    query = None
    for _ in range(2):  # the second time every event that is older than the watermark is dropped
        told.write.mode("append").parquet(f"{root}/in")
        stream = jobs.event_stream(spark, f"{root}/in", files_per_batch=1 << 30).withWatermark("ts", "10 days").dropDuplicates(["event_id", "ts"])
        query = jobs.drain(stream, "", f"{root}/checkpoint", sink=lambda batch, n: batch.write.mode("append").parquet(f"{root}/out"))
    return spark.createDataFrame([(jobs.late_rows(query),)], "dropped long")


@query("S11_json_sinks", "SELECT 'batch' AS sink, event_id, event_type FROM events UNION ALL SELECT 'stream', event_id, event_type FROM events")
def s11(spark, sf_dir):
    """Events read back from a batch and a streaming sink of JSON lines."""
    root = shared_path(spark, "json")
    told = table(spark, sf_dir, "events")
    files.write_records(told.select("event_id", "event_type"), f"{root}/batch")
    told.write.parquet(f"{root}/in")
    files.write_records(jobs.event_stream(spark, f"{root}/in").select("event_id", "event_type"), f"{root}/stream", f"{root}/checkpoint")
    read = lambda name: spark.read.schema("event_id long, event_type string").json(f"{root}/{name}").select(F.lit(name).alias("sink"), "event_id", "event_type")
    return read("batch").union(read("stream"))


@query("A13_sketched_ranks", "SELECT event_type, name, count(*) AS n, true AS within FROM events, (VALUES ('p50'), ('p95')) r(name) WHERE value IS NOT NULL GROUP BY ALL")
def a13_sketches(spark, sf_dir):
    """Ranks of the value per type from a stream's sketches, and whether their measured error is within twice the stated one."""
    root, ranks = shared_path(spark, "sketches"), {"p50": 0.5, "p95": 0.95}
    for _ in _fed(spark, sf_dir, root):
        jobs.keep_sketches(jobs.event_stream(spark, f"{root}/in", files_per_batch=1 << 30), f"{root}/out", f"{root}/checkpoint", ["event_type"], "value")
    found = evaluate.sketched_ranks(spark.read.parquet(f"{root}/out"), ["event_type"], ranks)
    found = sized(found, "ranks")
    errors = evaluate.rank_errors(table(spark, sf_dir, "events"), "event_type", "value", found, ranks)
    return errors.join(found.select("event_type", "n").hint("merge"), "event_type").select("event_type", "name", "n", (F.col("error") <= 2 * evaluate.RANK_ERROR).alias("within"))
