"""Results that don't depend on how the input is split, and queries that look at whole series."""

import math
import random

import duckdb
import pytest

from pyspark.sql import functions as F

from tessitura.operators import series, vocab
from tessitura.plans import columnar, extended


def test_means_next_to_a_threshold_are_summed_in_the_order_of_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for track in range(300):
        values = [rng.randrange(0, 11) for _ in range(20)]
        values += [10 - v for v in values]  # the mean of body is 0.15 but for rounding
        rows += [(track, v / 100) for v in values]
    for name, n in (("one", 1), ("seven", 7)):
        spark.createDataFrame(rows, "track long, x double").coalesce(1).write.option("maxRecordsPerFile", len(rows) // n + 1).parquet(str(tmp_path / name))
    want = {}
    for track, x in rows:
        want[track] = want.get(track, 0.0) + x * 3
    want = {t: s / 40 for t, s in want.items()}
    assert len({m < 0.15 for m in want.values()}) == 2
    for name in ("one", "seven"):
        t = spark.read.parquet(str(tmp_path / name)).select("track", F.lit("snare").alias("cls"), (F.col("x") * 3).alias("body"), F.lit(1.0).alias("decay"), series.place().alias("place"))
        got = vocab.drum_sound(t.repartition(5, "body"), ["track"]).select("track", "evidence.body", F.size("offers").alias("offers")).collect()
        assert {r["track"]: r["body"] for r in got} == want
        assert all((r["offers"] == 1) == (want[r["track"]] < 0.15) for r in got)


@pytest.mark.parametrize("name", ["q24_consecutive_cosine", "q24b_tonal_stability"])
def test_vectors_follow_each_other_across_blocks_of_ids(spark, tmp_path, name):
    rng = random.Random(5)
    ids = [0, 99, 100, 4095, 4096, 4097, 9000, 40000, 40001, 90000, 90100]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], k) for k in (1, 2) for i in ids if (i + k) % 3]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in columnar.QUERIES[name](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(columnar.ORACLES[name]).fetchall())
    assert got == want
    assert len(want) == (len(rows) - 2 if name.startswith("q24_") else 2)


def test_notes_of_runs_are_those_of_frames(spark):
    import numpy as np

    from tessitura.operators import notes

    rng = np.random.default_rng(2)
    f0, n = rng.choice([40.0, 41.0, 80.0, 55.0], 60), rng.integers(1, 30, 60)
    runs = [("a", int(s), int(k), float(x), True, 0.9) for s, k, x in zip(np.cumsum(n) - n, n, f0, strict=True)]
    frames = [("a", s + i, x, v, p) for _, s, k, x, v, p in runs for i in range(k)]
    a = notes.segment_notes(spark.createDataFrame(runs, "track string, frame long, length int, f0_hz double, voiced boolean, voiced_prob double"), ["track"], 512 / 44100)
    b = notes.segment_notes(spark.createDataFrame(frames, "track string, frame long, f0_hz double, voiced boolean, voiced_prob double"), ["track"], 512 / 44100)
    got, want = a.collect(), b.collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 10


def days(spark, rows, path, files=1):
    """``events`` of (user, type, day, value), in the order of their ids."""
    e = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, user_id long, event_type string, day long, value double")
    e = e.select("event_id", F.expr("timestamp_ntz'2024-01-01 12:00:00' + make_dt_interval(cast(day as int))").alias("ts"), "user_id", "event_type", "value")
    e.coalesce(1).sortWithinPartitions("event_id").write.option("maxRecordsPerFile", len(rows) // files + 1).parquet(f"{path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{path}/events.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["q06_presence", "q07_sections", "q52_section_merge", "q61_arrangement_lines"])
def test_levels_on_their_threshold_are_present_as_the_sql_has_them(spark, tmp_path, name):
    # the last bit of a quantile between two levels decides the least one
    cases = [(5, 107.47, 141.02, 19.14), (4, 57.16, 72.36, 10.17), (7, 179.82, 216.27, 29.16), (4, 232.1, 259.1, 37.65), (8, 265.8, 273.8, 40.23), (4, 69.68, 107.28, 14.4), (5, 211.27, 212.82, 31.83)]
    rows = []
    for user, (n, lo, hi, least) in enumerate(cases):
        rows += [(user, "view", day, v) for day, v in enumerate([least] * 2 + [lo] * (n - 3) + [hi])]
    con = days(spark, rows, tmp_path)
    plan, sql = {**columnar.QUERIES, **extended.QUERIES}[name], {**columnar.ORACLES, **extended.ORACLES}[name]
    got = plan(spark, str(tmp_path))
    want = con.sql(sql).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    if name == "q06_presence":
        assert {r["present"] for r in got.filter("bar = 0").collect()} == {True, False}


def test_levels_of_days_are_summed_in_the_order_of_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.randrange(3), "view", 0, rng.randrange(1, 30000) / 100) for _ in range(600)]
    want = {}
    for user, _, _, v in rows:
        s, n = want.get(user, (0.0, 0))
        want[user] = s + v * v, n + 1
    days(spark, rows, tmp_path, 7)
    assert {r["track"]: r["level"] for r in columnar.bars(spark, str(tmp_path)).collect()} == {u: math.sqrt(s / n) for u, (s, n) in want.items()}
