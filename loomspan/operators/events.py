"""Operational events: faults, access policy, rates, traces and profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import sized
from . import scan

#: Class and severity of a fault, by the first rule of which one alternative holds. An alternative maps the error's type ("kind"), its
#: message ("text") or the message in one case ("lower", "upper") to a pattern, and all its patterns must be found. Fixed values, in this order.
FAULT_RULES = (
    ("SECURITY_ERROR", 1, ({"upper": "PII"}, {"lower": "credential|exposure"})),
    ("SECURITY_ERROR", 1, ({"lower": "unauthorized access"}, {"lower": "audit.*tamper|tamper.*audit"})),
    ("AUTH_ERROR", 2, ({"text": "401|Unauthorized"}, {"kind": "AuthenticationError"})),
    ("AUTH_ERROR", 2, ({"text": "403|Forbidden"}, {"kind": "PermissionError", "lower": "api"})),
    ("NETWORK_ERROR", 2, ({"kind": "ConnectionRefused|ConnectionError"}, {"lower": "connection refused"})),
    ("NETWORK_ERROR", 2, ({"upper": "DNS"}, {"lower": "resolve"}, {"kind": "NameResolutionError"})),
    ("NETWORK_ERROR", 2, ({"text": "SSL"}, {"lower": "certificate"}, {"kind": "SSLError"})),
    ("NETWORK_ERROR", 3, ({"kind": "TimeoutError|Timeout"}, {"lower": "timed out"})),
    ("API_ERROR", 3, ({"text": "429|RateLimit"}, {"lower": "rate limit"})),
    ("API_ERROR", 2, ({"text": "404", "lower": "api|deployment|model"},)),
    ("API_ERROR", 2, ({"text": "500|502|503"}, {"kind": "InternalServerError"})),
    ("API_ERROR", 3, ({"kind": "BadRequest"}, {"text": "400", "lower": "api"})),
    ("INDEX_ERROR", 1, ({"lower": "sqlite|database"}, {"kind": "OperationalError"})),
    ("INDEX_ERROR", 2, ({"lower": "memmap|mmap"}, {"lower": "numpy.*error|error.*numpy"})),
    ("EMBEDDING_ERROR", 1, ({"text": "SentenceTransformer"}, {"lower": "embedding.*model|model.*embedding"})),
    ("RESOURCE_ERROR", 2, ({"text": "CUDA|OutOfMemory"}, {"lower": "out of memory"})),
    ("PARSE_ERROR", 3, ({"kind": "PDFSyntaxError"}, {"lower": "pdf.*(corrupt|parse)|(corrupt|parse).*pdf"})),
    ("PARSE_ERROR", 4, ({"kind": "UnicodeDecodeError"}, {"lower": "encoding"})),
    ("CONFIG_ERROR", 2, ({"kind": "YAMLError"}, {"lower": "yaml.*(parse|syntax)|(parse|syntax).*yaml"})),
    ("CONFIG_ERROR", 2, ({"lower": "config.*(missing|not found)|(missing|not found).*config"},)),
    ("RESOURCE_ERROR", 2, ({"kind": "MemoryError"}, {"lower": "memory.*error|error.*memory"})),
    ("RESOURCE_ERROR", 1, ({"lower": "disk.*full|full.*disk"}, {"text": "No space left"})),
    ("RETRIEVAL_ERROR", 3, ({"lower": "retriev.*(zero|empty|no results)|(zero|empty|no results).*retriev"},)),
)
OTHER_FAULT = ("INTERNAL_ERROR", 2)


def classify_fault(kind: Column, message: Column) -> Column:
    """Struct (error_class, severity) of an error by its type and message with context; the first rule that holds."""
    t, m = F.coalesce(kind, F.lit("")), F.coalesce(message, F.lit(""))
    fields = {"kind": t, "text": m, "lower": F.lower(m), "upper": F.upper(m)}

    def result(name: str, severity: int) -> Column:
        return F.struct(F.lit(name).alias("error_class"), F.lit(severity).alias("severity"))

    found = F
    for name, severity, alternatives in FAULT_RULES:
        either = [reduce(and_, (fields[f].rlike(f"(?s){pattern}") for f, pattern in parts.items())) for parts in alternatives]
        found = found.when(reduce(or_, either), result(name, severity))
    return found.otherwise(result(*OTHER_FAULT))


def http_error(status: Column, body: Column) -> Column:
    """Struct (code, message) of a failed response, with the first 300 characters of its body."""
    code = F.when(status == 401, "AuthRejected").when(status == 403, "Forbidden").when(status == 404, "DeploymentNotFound").when(status == 429, "RateLimited").when(status.between(500, 599), "ServerError").otherwise(F.concat(F.lit("API-"), status.cast("string")))
    return F.struct(code.alias("code"), F.concat(F.lit("HTTP "), status.cast("string"), F.lit(": "), F.left(F.coalesce(body, F.lit("")), F.lit(300))).alias("message"))


def url_policy(url: Column, mode: Column, hosts: Sequence[str] = (), prefixes: Sequence[str] = ()) -> Column:
    """Struct (allowed, rule) for an access. Admin may all; else http(s) only, the own machine always, listed hosts and prefixes online; other modes fail closed."""
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    listed = F.lit(False)
    for p in prefixes:
        listed = listed | url.startswith(p)
    cases = F.when(mode == "admin", "admin").when(~F.coalesce(scheme.isin("http", "https"), F.lit(False)) | (host == ""), "bad_scheme").when(host.isin("localhost", "127.0.0.1"), "localhost").when(mode == "offline", "offline_blocked")
    cases = cases.when((mode == "online") & host.isin(*hosts) if hosts else F.lit(False), "host_listed").when((mode == "online") & listed, "prefix_listed").when(mode == "online", "not_listed").otherwise("unknown_mode")
    return F.struct(cases.isin("admin", "localhost", "host_listed", "prefix_listed").alias("allowed"), cases.alias("rule"))


def stage_totals(events: DataFrame, run: str, stage: str) -> DataFrame:
    """Events of each stage of each run."""
    return events.groupBy(run, stage).agg(F.count("*").alias("n"))


def fault_summary(faults: DataFrame) -> DataFrame:
    """Counts by severity, by class and in all, unresolved ones, and the latest fault of each."""
    return faults.groupingSets([["severity"], ["error_class"], []], "severity", "error_class").agg(
        F.count("*").alias("n"), F.count_if(~F.col("resolved")).alias("unresolved"), F.max_by("fault_id", F.struct("ts", "fault_id")).alias("latest"))


def audit_summary(checks: DataFrame) -> DataFrame:
    """One row: checks, allowed, denied, and the sorted hosts that were asked for."""
    return checks.agg(F.count("*").alias("checks"), F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("denied"), F.array_sort(F.collect_set("host")).alias("hosts"))


def metric_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, sample deviation (0 for one value), least and greatest per key."""
    return df.groupBy(key).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("stdev"), F.min(value).alias("min"), F.max(value).alias("max"))


def top_values(df: DataFrame, dims: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` most common values of each dimension, ties by value."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims))).alias("x")).select("x.*")
    counts = long.groupBy("dim", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("n"), "value")).cast("long")
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def profile(df: DataFrame, dims: Sequence[str], time: str = "ts", k: int = 10) -> DataFrame:
    """``top_values`` with the first and last time of each value, and a row of dimension ``all`` for the whole table."""
    when = lambda x: (F.min(x).alias("first"), F.max(x).alias("last"))
    long = df.select(time, F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims))).alias("x")).select(time, "x.*")
    counts = long.groupBy("dim", "value").agg(F.count("*").alias("n"), *when(time))
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("n"), "value")).cast("long")
    whole = df.agg(F.count("*").alias("n"), *when(time)).select(F.lit("all").alias("dim"), F.lit(None).cast("string").alias("value"), "n", "first", "last", F.lit(1).cast("long").alias("rank"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).unionByName(whole)


def cost_by_day(log: DataFrame, budget: float) -> DataFrame:
    """Cost per day and key, and whether the day is over budget."""
    each = log.groupBy(F.to_date("ts").alias("day"), "key").agg(F.sum("cost").alias("c"))
    return each.withColumn("over_budget", F.sum("c").over(Window.partitionBy("day")) > budget).select("day", "key", F.round("c", 4).alias("cost"), "over_budget")


def traces(events: DataFrame, faults: DataFrame, seconds: int, most: int = 50_000) -> DataFrame:
    """``(fault_id, event_id)`` of ``events(event_id, second)`` within ``seconds`` of ``faults(fault_id, fault_second)``.

    Times are cut into buckets of that width; an event is compared with faults of
    its own and the two neighbouring buckets, so the join is on equality. A bucket
    with more than ``most`` events or faults is split on both sides: each part of
    its events meets each part of its faults, once.
    """
    near = faults.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("fault_second") / seconds) + d)))
    dealt = events.withColumn("bucket", F.floor(F.col("second") / seconds))
    count = lambda df, name: df.groupBy("bucket").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    dense = sized(count(dealt, "e").join(count(near, "f").hint("merge"), "bucket").where("e > 1 OR f > 1"), "dense")
    part = lambda key, n: F.pmod(F.xxhash64(key), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    mine = dealt.join(dense, "bucket", "left").withColumn("i", part("event_id", F.col("e"))).withColumn("j", every(F.col("f")))
    theirs = near.join(dense, "bucket", "left").withColumn("j", part("fault_id", F.col("f"))).withColumn("i", every(F.col("e")))
    both = mine.select("event_id", "second", "bucket", "i", "j").join(theirs.select("fault_id", "fault_second", "bucket", "i", "j").hint("merge"), ["bucket", "i", "j"])
    return both.where(F.abs(F.col("second") - F.col("fault_second")) <= seconds).select("fault_id", "event_id")


def rolling_speed(events: DataFrame, key: str, seconds: int = 30) -> DataFrame:
    """Adds ``speed``: value in the last ``seconds`` over the time since the first sample in them, at least 0.1 s."""
    w = Window.partitionBy(key).orderBy("second").rangeBetween(-seconds, 0)
    return events.withColumn("speed", F.round(F.sum("value").over(w) / F.greatest(F.col("second") - F.min("second").over(w), F.lit(0.1)), 6))


def running_eta(events: DataFrame, key: str, total: Column) -> DataFrame:
    """Adds ``done``, ``rate`` (per second so far) and ``eta`` (remaining over rate; null at the start)."""
    w = Window.partitionBy(key).orderBy("second", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    df = events.withColumn("done", F.count("*").over(w)).withColumn("rate", F.col("done") / F.nullif(F.col("second") - F.min("second").over(w), F.lit(0)))
    return df.withColumn("eta", F.round((total - F.col("done")) / F.col("rate"), 6)).withColumn("rate", F.round("rate", 6))


def ema(events: DataFrame, key: str, alpha: float = 0.25) -> DataFrame:
    """``(key, ema)``: exponential moving average of ``value`` in time order, seeded by the first; ties by event id.

    Each value is a step ``(1 - alpha) s + alpha value``; steps are composed by
    ranges of a run (``scan.affine``), so a long run is many tasks' work.
    """
    order = ["second", "event_id"]
    dealt = scan.deal(events.select(key, *order, "value"), [key], order)
    done = scan.affine(dealt, [key], order, "ema", F.lit(1 - alpha), F.lit(alpha) * F.col("value"), F.col("value"))
    return done.groupBy(key).agg(F.round(F.max_by("ema", F.struct(*order)), 6).alias("ema"))


#: Least time between two samples, and least rate for which a time is told. Fixed values.
LEAST_SECONDS, LEAST_RATE = 0.001, 1e-6


def smoothed_eta(events: DataFrame, key: str, total: Column, alpha: float = 0.25) -> DataFrame:
    """Adds ``done``, ``rate`` and ``eta`` to ``events(key, second, event_id, value)``: the time left at the smoothed rate.

    A sample's rate is its value (0 if null or negative) over the seconds since
    the run's sample before, 0.001 at least; ``rate`` is the moving average of
    these. A run's first sample starts the clock and has no rate. ``eta`` is what is
    left of ``total`` over the rate, null where total isn't positive or the rate
    not above 0.000001. Ties by event id; every run is scanned by ranges.
    """
    order = ["second", "event_id"]
    dealt = scan.deal(events, [key], order)
    timed = scan.last_before(dealt, [key], order, __before=F.col("second"))
    value = F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0))
    timed = scan.running(timed, [key], order, done=value)
    now = value / F.greatest(F.col("second") - F.col("__before"), F.lit(LEAST_SECONDS))
    # the first sample leaves the state as it is; the seed is the second one's rate
    later = scan.affine(timed.where("__before IS NOT NULL"), [key], order, "rate", F.lit(1 - alpha), F.lit(alpha) * now, now)
    first = timed.where("__before IS NULL").withColumn("rate", F.lit(None).cast("double"))
    left = F.greatest(total - F.col("done"), F.lit(0.0))
    eta = F.when((total > 0) & (F.col("rate") > LEAST_RATE), left / F.col("rate"))
    return later.unionByName(first).withColumn("eta", eta).drop("__before", scan.RANGE)


def last_n(events: DataFrame, key: str, n: int) -> DataFrame:
    """The last ``n`` events of each key, newest first."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("second"), F.desc("event_id"))).cast("long")
    return events.withColumn("rank", rank).where(F.col("rank") <= n)


def fault_state(log: DataFrame) -> DataFrame:
    """Whether each fault is resolved: its last event decides."""
    return log.groupBy("fault_id").agg(F.max_by("resolved", F.struct("ts", "event_id")).alias("resolved"))


def event_xml_fields(xml: Column) -> Column:
    """Struct (time, event_id, provider, data, line) of an event-log XML record; at most five data values."""
    pick = lambda p: F.regexp_extract(xml, p, 1)
    time, number, provider = pick(r'SystemTime=["\']([^"\']*)'), pick(r"<EventID[^>]*>([^<]*)<"), pick(r'<Provider[^>]*\bName=["\']([^"\']*)')
    data = F.slice(F.filter(F.regexp_extract_all(xml, F.lit(r"<Data[^>]*>([^<]*)</Data>"), 1), lambda d: F.trim(d) != ""), 1, 5)
    return F.struct(time.alias("time"), number.alias("event_id"), provider.alias("provider"), data.alias("data"), F.concat_ws(" ", time, number, provider, F.array_join(data, " | ")).alias("line"))


def details_lines(details: Column) -> Column:
    """A map as ``k=v`` lines in key order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(details)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n")
