"""Both jobs: against SQL, against Python on small tables, over growing input, after a failure, and from the command line."""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path
from statistics import median

import duckdb
import pytest
from jobs import common, daily_traffic, queries, trace_catalogue
from tests.test_queries import DATA, rows

HERE = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    before = dict(spark.conf.getAll)
    assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == rows(c.execute(queries.SQL[name]).df())
    assert dict(spark.conf.getAll) == before


def test_configuration(tmp_path):
    for job in (trace_catalogue, daily_traffic):
        assert common.configuration(job.CONFIG, job.DEFAULTS) == job.DEFAULTS
    bad = tmp_path / "c.toml"
    for text in ("other = 1", "quantile = 1", 'bin_seconds = "60"'):
        bad.write_text(text)
        with pytest.raises(ValueError):
            common.configuration(bad, daily_traffic.DEFAULTS)
    bad.write_text("quantile = 0.5")
    assert common.configuration(bad, daily_traffic.DEFAULTS)["quantile"] == 0.5


# Catalogue

TURNS = [
    *((1, i, ["user", "assistant"][i % 2], "x" * i) for i in range(6)),
    *((2, i, "user", "é") for i in range(3)),
    (3, 0, "user", "a"), (3, 0, "assistant", "b"), (3, 1, "user", None),
    (4, 1, "user", "a"), (4, 3, "tool", ""), (4, 4, " Assistant ", "c"),
    (5, 0, "robot", "a"), (5, 1, None, "a"),
    (6, 0, "user", "alone"),
    (None, 0, "user", "a"), (7, None, "user", "a"),
    *((8, i, ["system", "user", "assistant"][i], None) for i in range(3)),
    *((i, j, ["user", "assistant"][j % 2], "y" * (i * j % 7)) for i in range(20, 40) for j in range(1 + i % 5)),
]


def expected(turns):
    per = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None and t is not None:
            side = {"user": 0, "assistant": 1, "system": 1, "tool": 1}.get((r or "").strip().lower())
            per[c].append((t, side, len((x or "").encode()) + 54))
    out, valid = {}, {}
    for c, events in per.items():
        events.sort(key=lambda e: e[0])
        places = [e[0] for e in events]
        faults = []
        if len(set(places)) < len(places):
            faults.append("repeated_turns")
        if set(range(max(places) + 1)) - set(places):
            faults.append("missing_turns")
        if any(e[1] is None for e in events):
            faults.append("unknown_roles")
        if len(events) < 2:
            faults.append("too_few_events")
        out[str(c)] = ["held_out" if hashlib.sha256(str(c).encode()).hexdigest()[0] in "01" else "training", len(events), ",".join(faults)]
        if not faults:
            valid[str(c)] = events
    pool = sorted(n for c, e in valid.items() if out[c][0] == "training" for _, _, n in e)
    for c, events in valid.items():
        lengths = sorted(n for _, _, n in events)
        share = lambda sample, x: sum(n <= x for n in sample) / len(sample)
        distance = max(abs(share(pool, x) - share(lengths, x)) for x in pool + lengths)
        changes = sum(a[1] != b[1] for a, b in zip(events, events[1:], strict=False))
        out[c] += [changes, sum(e[1] == 0 for e in events), sum(e[2] for e in events if e[1] == 1), lengths[0], median(lengths), lengths[-1], round(distance, 9)]
    return out


def test_catalogue(spark, tmp_path):
    table, place = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string").repartition(3).write.parquet(table)
    found = []
    for _ in range(2):
        got = trace_catalogue.run(spark, table, place)
        found.append({
            r.conversation: [r.split, r.events, r.faults] + ([r.side_changes, r.outbound_packets, r.inbound_bytes, r.length_minimum, r.length_median, r.length_maximum, r.length_distance] if r.status == "valid" else [])
            for r in got.collect()
        })
        assert got.where("status = 'invalid' AND (side_changes IS NOT NULL OR length_minimum IS NOT NULL)").isEmpty()
    assert found[0] == found[1] == expected(TURNS)
    assert {p.name for p in Path(place).iterdir() if p.is_dir()} == {"status=valid", "status=invalid"}


def test_empty_catalogue(spark, tmp_path):
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/in")
    c = trace_catalogue.catalogue(spark.read.parquet(f"{tmp_path}/in"), trace_catalogue.DEFAULTS, [])
    assert c.count() == 0


# Daily traffic

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
NOON = dt.datetime(2024, 3, 1, 12)


def event(i, minutes, kind="view", user=1, value=1.0):
    return (i, None if minutes is None else NOON + dt.timedelta(minutes=minutes), user, kind, value, "{}")


def day_report(events):
    """{(day, type): figures} in Python."""
    least = {}
    for i, ts, user, kind, value, _ in events:
        if i is not None and ts is not None:
            row = (ts, kind or "", (user or 0) % 2, 60 + round((value or 0.0) * 100) % 1455)
            least[ts.date(), i] = min(least.get((ts.date(), i), row), row)
    per = defaultdict(list)
    for (day, _), (ts, kind, side, n) in least.items():
        per[str(day), kind].append((ts, side, n))
    out = {}
    for key, e in per.items():
        e.sort()
        gaps = [(b[0] - a[0]) // dt.timedelta(microseconds=1) for a, b in zip(e, e[1:], strict=False)]
        bins = Counter(t.replace(second=0, microsecond=0) for t, _, _ in e)
        out[key] = (len(e), sum(n for *_, n in e), sum(s == 0 for _, s, _ in e), median(n for *_, n in e), median(gaps) if gaps else None, gaps.count(0) if gaps else None, max(bins.values()))
    return out


def collected(report):
    return {(str(r.day), r.event_type): (r.packets, r.bytes, r.outbound_packets, r.length_median, r.gap_median, r.gap_zero_count, r.busiest_bin) for r in report.collect()}


def test_growing_input(spark, tmp_path):
    """Two runs over growing input: the second takes the new files alone and redoes the days they touch alone."""
    source, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"

    def add(events):
        spark.createDataFrame(events, EVENTS).coalesce(1).write.mode("append").parquet(source)

    first = [event(i, i * 7, ["view", "buy"][i % 2], i, i / 3) for i in range(400)] + [event(1000, None), event(None, 5), event(1001, 3, None, None, None)]
    add(first)
    assert collected(daily_traffic.run(spark, source, out, mark)) == day_report(first)
    files = {p: p.stat().st_mtime_ns for p in Path(out, "report").rglob("*.parquet")}
    assert collected(daily_traffic.run(spark, source, out, mark)) == day_report(first)
    assert {p: p.stat().st_mtime_ns for p in Path(out, "report").rglob("*.parquet")} == files

    late = [event(2000 + i, 5 + i, "view", 2, 9.0) for i in range(5)]  # belong to the first day
    again = [event(3, 21, "view", 7, 0.5), event(4, 28, "view", 4, 4 / 3)]  # come a second time, once with other values
    new = [event(3000 + i, 4 * 1440 + i // 2, "buy", i, 2.0) for i in range(9)]
    add(late + again)
    add(new)
    assert collected(daily_traffic.run(spark, source, out, mark)) == day_report(first + late + again + new)
    kept = {p for p in Path(out, "report").rglob("*.parquet") if p in files}
    assert {p.parent.name for p in kept} == {"day=2024-03-02", "day=2024-03-03"} and len(list(Path(mark, "commits").glob("[0-9]*"))) == 2


def test_a_batch_that_failed_is_done_again(spark, tmp_path):
    source, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    one, two = [event(i, i) for i in range(30)], [event(i, i * 3, "buy") for i in range(100, 140)]
    for part in (one, two):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        daily_traffic.run(spark, source, out, mark)
    for f in Path(mark, "commits").glob("*1*"):  # as if the last batch had written all but its mark
        f.unlink()
    for p in Path(out, "report").rglob("*.parquet"):  # and its report only in part
        p.unlink()
        break
    assert collected(daily_traffic.run(spark, source, out, mark)) == day_report(one + two)
    assert spark.read.parquet(f"{out}/landed").count() == 70


def test_batches_of_few_files(spark, tmp_path):
    source = f"{tmp_path}/in"
    all_ = [event(i, i * 11, "view", i) for i in range(200)]
    for k in range(5):
        spark.createDataFrame(all_[k::5], EVENTS).coalesce(1).write.mode("append").parquet(source)
    got = daily_traffic.run(spark, source, f"{tmp_path}/out", f"{tmp_path}/mark", {"files_per_batch": 2})
    assert collected(got) == day_report(all_)
    assert spark.read.parquet(f"{tmp_path}/out/landed").select("batch").distinct().count() == 3


def test_only_whole_days_are_read(spark, tmp_path):
    """The report of a batch reads the landed partitions of its own days."""
    rows_ = [(i, i * 10**9, "view", 1, 60, dt.date(2024, 1, 1 + i % 3), i % 2) for i in range(30)]
    place = f"{tmp_path}/landed"
    spark.createDataFrame(rows_, daily_traffic.LANDED).write.partitionBy("day", "batch").parquet(place)
    landed = spark.read.schema(daily_traffic.LANDED).parquet(place)
    days = daily_traffic.days_of(landed, 1)
    assert days == [dt.date(2024, 1, d) for d in (1, 2, 3)] and daily_traffic.days_of(landed, 7) == []
    one = daily_traffic.of_days(landed, days[1:2])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "2024-01-02" in plan.split("PartitionFilters: [")[1].split("]")[0] and one.count() == 10


def test_command_lines(tmp_path):
    """Both as a user starts them, on copies of the smallest tables."""
    env = os.environ | {"PYTHONPATH": str(HERE), "PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 --conf spark.sql.warehouse.dir={tmp_path}/warehouse pyspark-shell"}
    for name, args, log, place in (
        ("trace_catalogue", ["--conversations", f"{DATA}/conversations.parquet", "--output", f"{tmp_path}/c"], "wrote", "c/status=valid"),
        ("daily_traffic", ["--events", f"{DATA}/events.parquet", "--output", f"{tmp_path}/d", "--checkpoint", f"{tmp_path}/m"], "took 1 new batches", "d/report"),
    ):
        done = subprocess.run([sys.executable, "-m", f"jobs.{name}", *args], cwd=HERE, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "read" in done.stderr and log in done.stderr and list((tmp_path / place).rglob("*.parquet"))
