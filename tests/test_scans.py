"""Two-level scans, split joins, stateful streams and the quarantine, against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan import session
from loomspan.operators import evaluate, events, ingest, manifest, scan, search
from loomspan.streaming import jobs


def samples(r, keys, most):
    rows, i = [], 0
    for key in keys:
        second = 0
        for _ in range(r.randint(1, most)):
            second += r.choice([0, 0, 1, 7])
            rows.append((key, second, i, r.choice([None, -1.0, 0.0, float(r.randint(1, 99))])))
            i += 1
    r.shuffle(rows)
    return rows


def test_scans_equal_a_loop(spark):
    r = random.Random(3)
    rows = samples(r, [1, 2, 3, None], 150)
    df = spark.createDataFrame(rows, "key long, second long, event_id long, value double")
    dealt = scan.deal(df, ["key"], ["second", "event_id"], 7)
    assert dealt.select(scan.RANGE).distinct().count() == 7
    done = scan.last_before(dealt, ["key"], ["second", "event_id"], before=F.col("value"))
    done = scan.running(done, ["key"], ["second", "event_id"], total=F.col("value"))
    value = F.coalesce("value", F.lit(0.0))
    got = {x.event_id: x for x in scan.affine(done, ["key"], ["second", "event_id"], "s", F.lit(0.75), 0.25 * value, value).collect()}
    state = {}
    for key, _, i, v in sorted(rows, key=lambda x: (str(x[0]), x[1], x[2])):
        before, total, s = state.get(key, (None, 0.0, None))
        total += v or 0.0
        s = 0.75 * (v or 0.0) + 0.25 * (v or 0.0) if s is None else 0.75 * s + 0.25 * (v or 0.0)
        assert got[i].before == before and got[i].total == pytest.approx(total) and got[i].s == pytest.approx(s)
        state[key] = (before if v is None else v, total, s)
    assert len(got) == len(rows)


def test_composed_steps():
    r = np.random.default_rng(2)
    a, b, first = r.random(50), r.random(50), r.random(50) < 0.1
    first[0] = True
    x, y = scan.compose(a, b, first)
    p, q = 1.0, 0.0
    for k in range(50):
        p, q = (a[k], b[k]) if first[k] else (a[k] * p, a[k] * q + b[k])
        assert (x[k], y[k]) == (pytest.approx(p), pytest.approx(q))


def test_a_long_run_is_the_work_of_many_tasks(spark):
    """No range and no segment of a single run holds more than its share, and the average is that of a loop."""
    n = 20_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("second"), F.col("id").alias("event_id"), (F.col("id") % 10).cast("double").alias("value"))
    dealt = scan.deal(df, ["key"], ["second", "event_id"], 8)
    assert max(r["count"] for r in dealt.groupBy(scan.RANGE).count().collect()) < n / 4
    ema = 0.0
    for i in range(n):
        ema = i % 10 if i == 0 else 0.25 * (i % 10) + 0.75 * ema
    assert events.ema(df, "key").first().ema == pytest.approx(ema, abs=1e-6)


def test_eta_of_odd_samples(spark):
    rows = [(1, 0, 1, 5.0), (1, 10, 2, 20.0), (1, 10, 3, 1.0), (2, 5, 4, 1.0), (3, 1, 5, None), (3, 2, 6, None)]
    got = {x.event_id: (x.done, x.rate, x.eta) for x in events.smoothed_eta(spark.createDataFrame(rows, "run long, second long, event_id long, value double"), "run", F.lit(100.0)).collect()}
    assert got[1] == (5.0, None, None) and got[2] == (25.0, 2.0, 37.5) and got[4] == (1.0, None, None)
    rate = 0.25 * 1000 + 0.75 * 2
    assert got[3] == (26.0, pytest.approx(rate), pytest.approx(74 / rate))
    assert got[6] == (0.0, 0.0, None)
    assert events.smoothed_eta(spark.createDataFrame([], "run long, second long, event_id long, value double"), "run", F.lit(1.0)).count() == 0


def test_previous_run_over_ranges(spark):
    r = random.Random(6)
    runs = [(k, r.randint(0, 40), r.choice(["completed", "failed"])) for k in range(300)]
    got = {x.run_id: x.previous for x in manifest.previous_completed(spark.createDataFrame(runs, "run_id long, started long, status string")).collect()}
    last = None
    for k, _, status in sorted(runs, key=lambda x: (x[1], x[0])):
        assert got[k] == last
        last = k if status == "completed" else last


def test_dense_buckets_are_split_without_loss(spark):
    r = random.Random(9)
    told = [(k, r.choice([100, 101, 119, 500, r.randint(0, 900)])) for k in range(600)]
    faults = [(k, s) for k, s in told if k % 5 == 0]
    got = sorted(map(tuple, events.traces(spark.createDataFrame(told, "event_id long, second long"), spark.createDataFrame(faults, "fault_id long, fault_second long"), 20, most=10).collect()))
    assert got == sorted((f, e) for f, a in faults for e, b in told if abs(a - b) <= 20)


def fed(spark, root, batches, job, mode="append"):
    out = []
    for rows in batches:
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.mode("append").parquet(f"{root}/in")
        query = job(jobs.event_stream(spark, f"{root}/in", files_per_batch=1 << 30)).writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
        query = query.foreachBatch(lambda df, n: out.extend(df.collect())).start()
        query.awaitTermination()
    return out, query


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_flight_log_gives_every_event_once(spark, tmp_path):
    rows = [(k, at(k), k % 3, "view", 1.0, "") for k in range(70)]
    with jobs.state_store(spark):
        job = lambda s: jobs.flight_log(s, n=5, block=8, idle="30 minutes", late="1 minute")
        out, _ = fed(spark, tmp_path, [rows[:40], rows[40:], [(-1, at(5000), -1, "end", 0.0, "")]], job)
    log = [x for x in out if x.user_id >= 0]
    assert sorted(x.event_id for x in log) == list(range(70))
    sizes = {}
    for x in log:
        sizes[x.user_id, x.block] = sizes.get((x.user_id, x.block), 0) + 1
    for user in range(3):
        n = sum(k % 3 == user for k in range(70))
        assert sorted(v for (u, _), v in sizes.items() if u == user) == sorted([8] * (n // 8) + [n % 8] * (n % 8 > 0))
    kept = {}
    for x in jobs.kept_state(spark, f"{tmp_path}/checkpoint", "recent").collect():
        kept.setdefault(x.user_id, []).append(x.event_id)
    assert {u: sorted(v) for u, v in kept.items() if u >= 0} == {u: [k for k in range(70) if k % 3 == u][-5:] for u in range(3)}


def test_flight_log_keeps_users_in_groups(spark, tmp_path):
    """Very many users are a bounded number of keys, and each one's events are still given out once, in blocks of its own."""
    rows = [(k, at(k % 20), k % 2000 if k < 4000 else k % 3, "view", 1.0, "") for k in range(4200)]
    with jobs.state_store(spark):
        job = lambda s: jobs.flight_log(s, n=4, block=8, idle="30 minutes", late="30 minutes")
        out, _ = fed(spark, tmp_path, [rows[:2600], rows[2600:], [(-1, at(5000), -1, "end", 0.0, "")]], job)
    log = [x for x in out if x.user_id != -1]
    assert sorted((u, i, t, k) for i, t, u, k, _, _ in rows) == sorted((x.user_id, x.event_id, x.ts, x.event_type) for x in log)
    sizes = {}
    for x in log:
        sizes.setdefault(x.user_id, {}).setdefault(x.block, []).append(x)
    assert all(sorted(b) == list(range(len(b))) and all(len(v) == 8 for k, v in b.items() if k < len(b) - 1) for b in sizes.values())
    keys = spark.read.format("statestore").option("path", f"{tmp_path}/checkpoint").option("stateVarName", "recent").load().select("key").distinct().count()
    assert len(sizes) == 2000 and keys <= 1024


def test_kept_state_of_odd_rows(spark, tmp_path):
    """Users and events without an id, very large ids, and events without a time or type stay apart and whole in the state and the log."""
    r = random.Random(3)
    users = [None, 0, -7, 2**62 + 1, 2**62 + 2, *range(40)]
    rows = [(k if k % 97 else None, at(r.randint(0, 20)) if k % 13 else None, r.choice(users), r.choice(["view", None]), 1.0, "") for k in range(600)]
    rows[4] = (2**60 + 1, *rows[4][1:])
    with jobs.state_store(spark):
        job = lambda s: jobs.flight_log(s, n=4, block=8, idle="30 minutes", late="30 minutes", groups=6)
        out, _ = fed(spark, tmp_path, [rows[:250], rows[250:], [(-1, at(5000), -1, "end", 0.0, "")]], job)
    plain = lambda rows: sorted(rows, key=repr)
    assert plain((u, i, t, k) for i, t, u, k, _, _ in rows) == plain((x.user_id, x.event_id, x.ts, x.event_type) for x in out if x.user_id != -1)
    kept, want = {}, {}
    for x in jobs.kept_state(spark, f"{tmp_path}/checkpoint", "recent").collect():
        kept.setdefault(x.user_id, []).append((x.ts, x.event_id))
    for i, t, u, _, _, _ in rows:
        want.setdefault(u, []).append((t, i))
    late = lambda e: (e[0] is not None, e[0] or at(0), e[1] is not None, e[1] or 0)
    assert {u: plain(v) for u, v in kept.items() if u != -1} == {u: plain(sorted(v, key=late)[-4:]) for u, v in want.items()}


def test_rates_expire_when_a_run_is_idle(spark, tmp_path):
    rows = [(k, at(k), k % 2, "view", float(k), "") for k in range(20)]
    job = lambda s: jobs.ema_rate(s, total=1000.0, idle="30 minutes", late="1 minute")
    out, query = fed(spark, tmp_path, [rows[:10], rows[10:], [(-1, at(5000), 9, "end", 0.0, "")], [(-2, at(5001), 9, "end", 0.0, "")]], job, "update")
    ended = {x.user_id: x for x in out if x.ended}
    assert set(ended) == {0, 1}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # the run of the last event alone
    batch = spark.createDataFrame([(k % 2, 60 * k, k, float(k)) for k in range(20)], "run long, second long, event_id long, value double")
    last = {x.run: x for x in events.smoothed_eta(batch, "run", F.lit(1000.0)).where("event_id >= 18").collect()}
    for user in (0, 1):
        assert (ended[user].done, ended[user].rate, ended[user].eta) == (pytest.approx(last[user].done), pytest.approx(last[user].rate), pytest.approx(last[user].eta))


def test_quarantine_round_trip(spark, tmp_path):
    rows = [(f"p{k}", [None, "bad / name", "empty"][k % 3], k) for k in range(30)]
    df, path = spark.createDataFrame(rows, "path string, reason string, size int"), f"{tmp_path}/q"
    ingest.write_quarantine(df, path)
    state = lambda: sorted(map(tuple, spark.read.parquet(path).select("path", "reason", "size", "disposition").collect()))
    before = state()
    ingest.move_quarantined(spark, path, ["bad / name", "no such reason"])
    assert [x[3] for x in state()] == ["quarantined" if x[1] == "empty" else "accepted" for x in state()] and len(state()) == 30
    ingest.move_quarantined(spark, path, ["bad / name"])  # again
    ingest.move_quarantined(spark, path, ["bad / name"], back=True)
    assert state() == before


def test_answers_by_mode(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "k int, mode string")
    got = {r.k: r.answer for r in search.answer_by_mode(df, {"a": lambda x: x.withColumn("answer", F.lit("A")), "b": lambda x: x.withColumn("answer", F.lit("B"))}).collect()}
    assert got == {1: "A", 2: "B", 3: None, 4: None}
    assert search.answer_by_mode(df, {}).where("answer IS NULL").count() == 4


def test_sketches_merge_within_their_error(spark):
    r = random.Random(7)
    rows = [(r.choice("ab"), k % 40, r.choice([r.gauss(0, 1), r.paretovariate(1), 0.0, None])) for k in range(40_000)]
    df = spark.createDataFrame(rows, "key string, hour int, value double").repartition(6)
    ranks = {"p01": 0.01, "p50": 0.5, "p95": 0.95}
    found = evaluate.sketched_ranks(evaluate.quantile_sketches(df, ["key", "hour"], "value"), ["key"], ranks)
    assert {x.key: x.n for x in found.collect()} == {k: sum(a == k and v is not None for a, _, v in rows) for k in "ab"}
    errors = evaluate.rank_errors(df, "key", "value", found, ranks).collect()
    assert len(errors) == 6 and max(x.error for x in errors) <= 2 * evaluate.RANK_ERROR
    assert evaluate.sketched_ranks(evaluate.quantile_sketches(df.limit(0), ["key"], "value"), ["key"], ranks).count() == 0


def test_appends_read_their_folders_only(spark, tmp_path):
    path, kind = f"{tmp_path}/chunks", "chunk_id string, source_path string, n int"
    rows = lambda a, b: spark.createDataFrame([(f"id{k}", f"s{k // 4}", k) for k in range(a, b)], kind)
    ingest.append_chunks(rows(0, 0), path)
    ingest.append_chunks(rows(0, 400), path, buckets=64)
    files = sorted(spark.read.parquet(path).inputFiles())
    ingest.append_chunks(rows(398, 402).union(rows(400, 401)), path, buckets=64)
    ingest.append_chunks(rows(0, 402), path, buckets=64)  # all there
    got = spark.read.parquet(path)
    assert sorted(r.n for r in got.collect()) == list(range(402))
    added = set(got.inputFiles()) - set(files)
    assert {f.split("bucket=")[1].split("/")[0] for f in added} <= {str(r.bucket) for r in rows(396, 404).select(F.pmod(F.xxhash64("source_path"), F.lit(64)).alias("bucket")).collect()}
    assert len({r.bucket for r in got.select("bucket").distinct().collect()}) > 10


def test_small_tables_are_dealt_over_all_cores(spark, tmp_path):
    """A file of one row group is one task's, so it is dealt; a table of as many splits as cores is not."""
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    cores, before = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.files.maxPartitionBytes")
    dealt = session.spread(t)
    assert dealt.select(F.spark_partition_id()).distinct().count() == cores and sorted(r.id for r in dealt.collect()) == list(range(1000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        assert session.spread(t) is t
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_renames_of_one_content_pair_in_path_order(spark):
    """Very many files of one content move: each deleted path meets the new path of its number."""
    before = [(f"a/{k:05d}", "same" if k % 3 else f"h{k}") for k in range(600)] + [("kept", "same"), ("none", None)]
    after = [(f"b/{k:05d}", "same" if k % 3 else f"h{k}") for k in range(550)] + [("kept", "same")]
    table = lambda rows: spark.createDataFrame(rows, "source_path string, content_hash string")
    got = {r.source_path: (r.change, r.renamed_from) for r in manifest.delta(table(before), table(after)).collect()}
    old = [p for p, h in before if h == "same" and p != "kept"]
    new = [p for p, h in after if h == "same" and p != "kept"]
    want = {b: ("renamed", a) for a, b in zip(old, new)} | {f"b/{k:05d}": ("renamed", f"a/{k:05d}") for k in range(0, 550, 3)}
    want |= {a: ("deleted", None) for a in old[len(new):]} | {f"a/{k:05d}": ("deleted", None) for k in range(0, 600, 3) if k >= 550}
    assert got == want | {"kept": ("unchanged", None), "none": ("deleted", None)}
