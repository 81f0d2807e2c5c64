"""Life cycles on streams and merges of batches: restarts, replays, killed runs."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from rillspark.sinks import bundles, merging
from rillspark.streaming import lifecycles

ALLOWED = [("open", "work"), ("work", "done"), ("work", "open"), ("timeout", "open")]
START = dt.datetime(2024, 1, 1)


def plain(changes, limit, until, first=("open",), final=("done",)):
    out = []
    for key in {c[0] for c in changes}:
        state = since = None

        def overdue(t, state, since):
            return state is not None and state not in {*final, "timeout"} and since + limit <= t

        for _, at, i, want in sorted((c for c in changes if c[0] == key and c[1] <= until), key=lambda c: (c[1], c[2])):
            if overdue(at, state, since):
                out.append((key, None, since + limit, state, "timeout", "timeout"))
                state, since = "timeout", since + limit
            ok = want in first if state is None else (state, want) in ALLOWED
            out.append((key, i, at, state, want, "accepted" if ok else "rejected"))
            if ok:
                state, since = want, at
        if overdue(until, state, since):
            out.append((key, None, since + limit, state, "timeout", "timeout"))
    return sorted(out, key=str)


def test_streams_agree_with_plain_replay_over_restarts(spark, tmp_path):
    r = random.Random(2)
    changes = [(r.randrange(6), START + dt.timedelta(minutes=r.randrange(3000)), i, r.choice(["open", "work", "done"])) for i in range(160)]
    limit, late = dt.timedelta(minutes=120), dt.timedelta(minutes=400)
    schema = "key long, ts timestamp, id long, state string"
    # within the lateness the order of arrival is free
    arrived = sorted(changes, key=lambda c: c[1] + dt.timedelta(minutes=r.randrange(300)))
    path = f"{tmp_path}/in"
    done = []
    for k in range(4):
        part = arrived[k * 40 : k * 40 + 40]
        done += part
        spark.createDataFrame(part + [(None, START, 1, "open"), (1, None, 1, "open")], schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        states = lifecycles.lifecycles(stream, "key", "ts", "id", "state", ALLOWED, limit, ["open"], ["done"], "400 minutes")
        # a new query each time: the state comes from the checkpoint
        lifecycles.replayed(states, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    until = max(c[1] for c in done) - late
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    assert got == plain(changes, limit, until)
    assert {g[5] for g in got} == {"accepted", "rejected", "timeout"}


# -- merges -------------------------------------------------------------------------------


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def batches(seed, n=5):
    r = random.Random(seed)
    return [[(r.choice([None, *range(30)]), r.randrange(50), f"b{k}r{j}") for j in range(25)] for k in range(n)]


@pytest.mark.parametrize("how", ["update", "keep"])
def test_merges_are_those_of_a_dictionary(spark, tmp_path, how):
    path, want = str(tmp_path), {}
    for k, rows in enumerate([*batches(1), [], [(None, 60, "z")]]):
        df = spark.createDataFrame(rows, "k long, v long, t string")
        for _ in range(2):  # the same batch again changes nothing
            new = merging.merge(df, k, path, ["k"], [F.desc("v"), F.col("t")], how, buckets=4)
        assert not new
        first = {}
        for key, v, t in sorted(rows, key=lambda x: (-x[1], x[2])):
            first.setdefault(key, (v, t))
        for key, (v, t) in first.items():
            if key not in want or how == "update" and (-v, t) < (-want[key][0], want[key][1]):
                want[key] = (v, t)
        assert rows_of(merging.read(spark, path)) == sorted(((k, *x) for k, x in want.items()), key=str)


def test_a_killed_run_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    path, parts = str(tmp_path), batches(3, 3)
    make = lambda rows: spark.createDataFrame(rows, "k long, v long, t string")
    merging.merge(make(parts[0]), 0, path, ["k"], [F.desc("v"), F.col("t")], buckets=4)
    before = rows_of(merging.read(spark, path))

    def dies(*a):
        raise KeyboardInterrupt

    monkeypatch.setattr(merging, "write_facts", dies)  # rows are written, the commit is not
    with pytest.raises(KeyboardInterrupt):
        merging.merge(make(parts[1]), 1, path, ["k"], [F.desc("v"), F.col("t")], buckets=4)
    assert rows_of(merging.read(spark, path)) == before
    monkeypatch.setattr(merging, "write_facts", bundles.write_facts)
    assert merging.merge(make(parts[1]), 1, path, ["k"], [F.desc("v"), F.col("t")], buckets=4)
    after = rows_of(merging.read(spark, path))
    assert after != before and not merging.merge(make(parts[1]), 1, path, ["k"], [F.desc("v"), F.col("t")], buckets=4)
    assert rows_of(merging.read(spark, path, 0)) == before
    merging.merge(make(parts[2]), 2, path, ["k"], [F.desc("v"), F.col("t")], buckets=4)
    last = rows_of(merging.read(spark, path))
    merging.vacuumed(spark, path, keep=1)
    assert rows_of(merging.read(spark, path)) == last and not os.path.exists(f"{path}/commits/0.json")


def test_a_stream_merges_and_goes_on(spark, tmp_path):
    path, source = f"{tmp_path}/table", f"{tmp_path}/in"
    seen = []
    for rows in batches(5, 3):
        seen += rows
        spark.createDataFrame(rows, "k long, v long, t string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k long, v long, t string").parquet(source)
        merging.merged_stream(stream, path, f"{tmp_path}/check", ["k"], [F.desc("v"), F.col("t")], buckets=4).awaitTermination()
    best = {}
    for k, v, t in sorted(seen, key=lambda x: (-x[1], x[2])):
        best.setdefault(k, (k, v, t))
    assert rows_of(merging.read(spark, path)) == sorted(best.values(), key=str)


def test_derived_files_are_registered_once(spark, tmp_path):
    files = lambda *rows: spark.createDataFrame([(d, n, p, c.encode()) for d, n, p, c in rows], "dataset string, name string, parent string, content binary")
    path = str(tmp_path)
    one = files(("a", "x", "p", "one"), ("a", "y", "p", "two"), ("a", "z", "p", "one"), ("b", "x", "q", "one"))
    assert merging.registered(one, 0, path) and not merging.registered(one, 0, path)
    merging.registered(files(("a", "w", "p", "two"), ("a", "v", "p", "three"), ("c", "u", "r", "")), 1, path)
    got = {(r.dataset, r.name, r.version, r["size"]) for r in merging.read(spark, path).collect()}
    assert got == {("a", "x", 1, 3), ("a", "y", 2, 3), ("b", "x", 1, 3), ("a", "v", 3, 5), ("c", "u", 1, 0)}


def test_a_change_reads_nothing_that_waits():
    import pandas as pd
    from unittest.mock import MagicMock

    m, handle = lifecycles.Machine(ALLOWED, ["open"], ["done"], dt.timedelta(minutes=1)), MagicMock()
    m.init(handle)
    m.now, m.waiting = MagicMock(), MagicMock()
    handle.listTimers.return_value = iter([9])
    assert not list(m.handleInputRows((1,), iter([pd.DataFrame({"at": [7000, 8000], "id": [1, 2], "state": ["open", "work"]})]), None))
    assert not m.waiting.get.called and not m.waiting.exists.called and not m.now.method_calls
    m.waiting.appendList.assert_called_once_with([(7000, 1, "open"), (8000, 2, "work")])
    handle.deleteTimer.assert_called_once_with(9)
    handle.registerTimer.assert_called_once_with(7)
