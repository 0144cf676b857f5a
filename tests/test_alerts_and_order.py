"""Greedy suppression and chunked numbering against plain loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablekeep.operators.alerts import suppress_alerts
from tablekeep.operators.ordering import cut_by_rows, dense_ids, last_before, neighbour, running_count

START = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("spread", [3, 40, 400])
def test_suppression_matches_loop(spark, spread):
    rng = np.random.default_rng(spread)
    rows = []
    for subject, n in (("hot", 900), ("b", 40), ("c", 1)):
        second = 0
        for _ in range(n):
            second += int(rng.integers(0, spread))
            rows.append((len(rows), START + dt.timedelta(seconds=second), subject))
    want, last = set(), {}
    for seq, ts, subject in sorted(rows, key=lambda r: (r[1], r[0])):
        if subject not in last or (ts - last[subject]).total_seconds() >= 300:
            want.add((seq, subject))
            last[subject] = ts
    alerts = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, subject string")
    got = {(r.seq, r.subject) for r in suppress_alerts(alerts, 300).collect()}
    assert got == want


def test_pieces_cut_a_busy_moment(spark):
    """60% of the rows are one key in one second; no piece holds more than a share of them."""
    rows = [("hot" if i % 5 < 3 else f"k{i % 97}", START, i) for i in range(4000)]
    cut = cut_by_rows(spark.createDataFrame(rows, "k string, ts timestamp_ntz, seq long"), ["k", "ts", "seq"], partitions=8)
    sizes = [r["count"] for r in cut.groupBy("_piece").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1200
    ordered = cut.orderBy("k", "ts", "seq").select("_piece").collect()
    assert [r[0] for r in ordered] == sorted(r[0] for r in ordered)


def test_dense_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), F.lit("x").alias("v"))
    got = dense_ids(df, ["k"], start=5, partitions=13).orderBy("gid").collect()
    assert [r.gid for r in got] == list(range(5, 1005))
    assert [r.k for r in got] == sorted(r.k for r in got)


def test_chunked_windows(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.random() < 0.2), i, int(rng.integers(0, 4)) or None) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, i int, v int")
    chunk = F.floor(F.col("i") / 16)
    out = neighbour(df, ["g"], ["i"], chunk, F.col("v"), "nxt", 1)
    out = neighbour(out, ["g"], ["i"], chunk, F.col("v"), "prv", -1)
    out = last_before(out, ["g"], ["i"], chunk, F.col("v"), "seen")
    out = running_count(out.withColumn("p", chunk), ["g"], "i", F.col("v").isNull(), "nulls", "p")
    got = {r.i: (r.nxt, r.prv, r.seen, r.nulls) for r in out.collect()}
    for g in (0, 1):
        mine = [(i, v) for gg, i, v in rows if gg == g]
        seen, nulls = None, 0
        for n, (i, v) in enumerate(mine):
            nulls += v is None
            nxt = mine[n + 1][1] if n + 1 < len(mine) else None
            assert got[i] == (nxt, mine[n - 1][1] if n else None, seen, nulls)
            seen = v if v is not None else seen


def test_pieces_stay_bounded_as_rows_double(spark):
    from pyspark.sql import functions as F

    from tablekeep.operators.ordering import cut_by_rows

    for n in (4_000, 8_000, 16_000, 32_000):
        rows = spark.range(n).select((F.col("id") % 3).alias("k"), F.col("id").alias("seq")).repartition(5)
        pieces = cut_by_rows(rows, ["k", "seq"], piece_rows=500).groupBy("_piece").count().collect()
        assert sum(r["count"] for r in pieces) == n
        assert max(r["count"] for r in pieces) <= 900, n


def test_two_writers_at_once_leave_both_changes(spark, tmp_path):
    import threading

    from tablekeep.sources import tables

    path, schema = str(tmp_path / "register"), "k int, who string"
    tables.write_register(spark.createDataFrame([(0, "first")], schema), path, ["k"])
    failures = []

    def write(n):
        try:
            for i in range(3):
                tables.write_register(spark.createDataFrame([(10 * n + i, f"writer {n}")], schema), path, ["k"])
        except Exception as exc:  # noqa: BLE001
            failures.append(exc)

    threads = [threading.Thread(target=write, args=(n,)) for n in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert failures == []
    assert sorted(r.k for r in tables.read_register(spark, path).collect()) == [0, 10, 11, 12, 20, 21, 22, 30, 31, 32]
    assert tables.latest_version(spark, path) == 9
    assert [r.k for r in tables.read_register(spark, path, 0).collect()] == [0]
    for i in range(3):  # retention: the oldest go with their data
        tables.write_register(spark.createDataFrame([(0, f"again {i}")], schema), path, ["k"], keep=3)
    assert sorted(int(p.name) for p in (tmp_path / "register" / "versions").iterdir() if p.name.isdigit()) == [10, 11, 12]
    assert len(list((tmp_path / "register" / "data").iterdir())) == 3
    (tmp_path / "register" / "versions" / "000000000013").touch()  # a writer that died at its marker
    assert tables.read_register(spark, path).filter("k = 0").first().who == "again 2"
    assert tables.write_register(spark.createDataFrame([(5, "after")], schema), path, ["k"]) == 14
    assert tables.read_register(spark, path).count() == 11
