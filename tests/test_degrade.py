"""One poisoned recording among many; estimators by name; rules as a table; bounded streams."""

import numpy as np
import pytest

from tessitura.operators import labels, notes, series, spectrum, tempo, tonal
from tessitura.operators.degrade import guarded, schema
from tessitura.sources import audio
from tessitura.streaming import windows


def test_a_group_that_raises_stays_alone(spark):
    rows = [(t, i, float(i % 7)) for t in "abcd" for i in range(40)]
    df = spark.createDataFrame(rows, "track string, frame long, x double")

    def run(pdf):
        import pandas as pd

        if pdf["track"].iloc[0] == "c":
            raise ZeroDivisionError("poison")
        return pd.DataFrame([{"track": pdf["track"].iloc[0], "total": pdf["x"].sum()}])

    got = {r["track"]: (r["total"], r["error"]) for r in df.groupBy("track").applyInPandas(guarded(run, ["track"], {"total": None}), schema(df, ["track"], "total double")).collect()}
    assert got.pop("c") == (None, "ZeroDivisionError: poison")
    assert set(got.values()) == {(sum(float(i % 7) for i in range(40)), None)} and set(got) == set("abd")


def test_a_tempo_that_cannot_be_measured(spark):
    rows = [("a", i, 1.0 if i % 43 == 0 else 0.0, 120.0) for i in range(4000)] + [("b", 0, None, 120.0)]
    got = {r["track"]: r for r in tempo.refine(spark.createDataFrame(rows, "track string, frame long, flux double, coarse double"), ["track"], 512 / 44100).collect()}
    assert got["a"]["status"] == "refined" and got["a"]["error"] is None
    assert got["b"]["status"] in ("coarse", "unavailable")


def test_pitch_estimators_by_a_column_and_a_poisoned_one(spark):
    t = np.arange(60_000) / 44100
    x = (np.sin(2 * np.pi * 110 * t) * 0.5).astype(np.float32)
    rows = [(name, "bass", c, p.tolist(), method) for name, method in (("a", "yin"), ("b", "yinfft"), ("c", "no such")) for c, p in audio.chunks(x)]
    chunks = spark.createDataFrame(rows, "track string, source string, chunk long, samples array<float>, method string")
    f0 = audio.pitch(chunks)
    got = f0.collect()
    bad = [r for r in got if r["track"] == "c"]
    assert len(bad) == 1 and bad[0]["error"].startswith("KeyError") and bad[0]["frame"] is None
    for name in ("a", "b"):
        alone = audio.pitch(chunks.filter(f"track = '{name}'")).collect()
        assert sorted(map(str, alone)) == sorted(str(r) for r in got if r["track"] == name) and all(r["error"] is None for r in alone)
    wanted = spark.createDataFrame([("a", False), ("b", False), ("c", False), ("d", True)], "track string, silent boolean")
    grid = spark.createDataFrame([(k, 0.0, 0.125, 16, 0.5, 0.0) for k in "abcd"], "track string, anchor_seconds double, step_seconds double, steps_per_cycle int, beat_period_seconds double, downbeat_seconds double")
    lines = {r["track"]: r["bass_line"] for r in notes.bass_line(f0.drop("source"), grid, wanted, ["track"], 512 / 44100).collect()}
    assert lines["a"]["status"] == lines["b"]["status"] == "ok" and {n["midi"] for n in lines["a"]["notes"]} == {45}
    assert lines["c"]["status"] == "failed" and "KeyError" in lines["c"]["caveats"][0] and lines["d"]["status"] == "silent"
    with pytest.raises(ValueError):
        audio.pitch(chunks, "none")


def test_bass_caveats(spark):
    hop = 512 / 44100
    high = [("h", i, 440.0 * 2 ** ((60 + 0.4 - 69) / 12), True, 0.9) for i in range(200)]
    few = [("f", i, 55.0, i < 50, 0.9) for i in range(200)]
    wanted = spark.createDataFrame([("h", False), ("f", False)], "track string, silent boolean")
    empty = spark.createDataFrame([], "track string, anchor_seconds double, step_seconds double, steps_per_cycle int, beat_period_seconds double, downbeat_seconds double")
    got = {r["track"]: r["bass_line"] for r in notes.bass_line(spark.createDataFrame(high + few, "track string, frame long, f0_hz double, voiced boolean, voiced_prob double"), empty, wanted, ["track"], hop).collect()}
    said = " ".join(got["h"]["caveats"])
    assert "high for a bass" in said and "+40 cents" in said and "no grid" in said
    assert any("25% of the frames" in c for c in got["f"]["caveats"])


def test_nearest_peak_takes_the_earlier_of_equals(spark):
    env = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 1.0, 3.0, 3.0, 2.0, 0.0, 0.0, 0.0, float("nan"), 0.0])], "track string, frame long, value double")
    times = spark.createDataFrame([("a", 0, 0.9), ("a", 1, 3.4), ("a", 2, 7.6), ("a", 3, 99.0), ("b", 4, 1.0)], "track string, id int, t double")
    got = {r["id"]: (r["peak_frame"], r["peak"]) for r in series.nearest_peak(times, env, 2, 1.0, ["track"]).collect()}
    assert got == {0: (2, 3.0), 1: (2, 3.0), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_flatness_of_hits_over_chunk_borders(spark):
    rng = np.random.default_rng(0)
    n = 2 * audio.CHUNK_FRAMES * audio.HOP + 40_000
    x = (rng.standard_normal(n) * 0.1).astype(np.float32)
    x[: 100 * 512] = np.sin(2 * np.pi * 430.66 * np.arange(100 * 512) / 44100)
    chunks = spark.createDataFrame([("a", "drums", c, p.tolist()) for c, p in audio.chunks(x)], "track string, source string, chunk long, samples array<float>")
    spans = [(10, 20), (500, 522), (511, 513), (512, 530), (1023, 1045)]
    hits = spark.createDataFrame([("a", "drums", a, b) for a, b in spans], "track string, source string, frame long, end long")
    got = {r["frame"]: r for r in audio.hit_spectra(chunks, hits).withColumn("flat", spectrum.flatness(audio.F.col("power"))).collect()}
    power = audio.power_frames(np.r_[np.zeros(1024), x, np.zeros(2048)])
    for a, b in spans:
        p = power[a:b].sum(0)
        assert np.allclose(got[a]["power"], p, rtol=1e-9, atol=1e-9)
        p = np.maximum(p, p.max() * spectrum.FLATNESS_FLOOR)
        assert abs(got[a]["flat"] - np.exp(np.log(p).mean()) / p.mean()) < 1e-9
    assert got[10]["flat"] < 0.01 < 0.5 < got[512]["flat"]


def test_pitch_classes_of_peaks(spark):
    t = np.arange(44100 * 2) / 44100
    x = sum(np.sin(2 * np.pi * f * t) for f in (440.0, 523.25, 659.26)).astype(np.float32) / 4
    chunks = spark.createDataFrame([("a", "other", c, p.tolist()) for c, p in audio.chunks(x)], "track string, source string, chunk long, samples array<float>")
    peaks = audio.frame_peaks(chunks)
    middle = [r for r in peaks.collect() if r["frame"] == 80]
    strongest = sorted(r["hz"] for r in sorted(middle, key=lambda r: -r["magnitude"])[:3])
    assert np.allclose(strongest, (440.0, 523.25, 659.26), atol=1.5) and len(middle) <= audio.MOST_PEAKS
    chroma = tonal.peak_classes(peaks, ["track", "source", "frame"])
    key = tonal.estimate_key(chroma.filter("frame between 20 and 150").groupBy("track").agg(audio.F.array(*[audio.F.avg(audio.F.get("chroma", audio.F.lit(i))) for i in range(12)]).alias("chroma")), ["track"]).first()
    assert (key["key"], key["scale"]) == ("a", "minor")
    # a peak between two classes goes to both alike, one on a class to it alone
    hz = lambda midi: 440 * 2 ** ((midi - 69) / 12)
    p = spark.createDataFrame([("x", hz(60.5), 2.0), ("y", hz(71), 1.0), ("y", hz(47), 1.0), ("z", 20.0, 1.0), ("z", 300.0, 0.0)], "track string, hz double, magnitude double")
    got = {r["track"]: r["chroma"] for r in tonal.peak_classes(p, ["track"]).collect()}
    assert set(got) == {"x", "y"} and np.allclose(got["x"][:2], 1) and sum(got["x"][2:]) == 0
    assert got["y"][11] == 1 and sum(got["y"][:11]) == 0


def test_rules_of_a_table_are_those_in_code_and_may_be_added_to(spark):
    rng = np.random.default_rng(3)
    names = labels.DESCRIPTORS
    scale = {"loudness_lufs": (-60, 50), "rms_mean": (0, 0.2), "crest_factor": (1, 20), "onset_density": (0, 10), "centroid_energy_hz": (50, 6000), "centroid_mean": (50, 6000), "centroid_std": (0, 2500), "chroma_entropy": (0, 1), "band_low": (0, 1), "band_high": (0, 1), "transient_sharpness": (0, 10)}
    rows = [(f"t{i}", s, *[None if rng.random() < 0.1 else float(scale[n][0] + rng.random() * scale[n][1]) for n in names]) for i in range(40) for s in ("drums", "bass", "vocals", "other", "mix")]
    df = spark.createDataFrame(rows, "track string, source string, " + ", ".join(f"{n} double" for n in names))
    show = lambda d: sorted((r["track"], r["source"], r["label"], round(r["confidence"], 9), tuple(sorted(r["evidence"].items()))) for r in d.collect())
    rules = labels.rule_rows(spark)
    keys = ["track", "source"]
    assert show(labels.label_by(df, rules, keys)) == show(labels.label(df, keys))
    more = rules.unionAll(spark.createDataFrame([("very low", "any", "band_low", 0.8, 1.0), ("odd", "any", "nothing of the kind", 0.0, 1.0)], labels.RULE_ROW))
    got = {r["label"] for r in labels.label_by(df, more, keys).collect()}
    assert "very low" in got and "odd" not in got


def test_a_bounded_stream_evicts_and_keeps_late_rows_apart(spark, tmp_path):
    schema_ = "ts timestamp, event_type string, value double"
    files = [[("00:10", 1.0), ("00:50", 2.0)], [("03:10", 4.0)], [("03:20", 8.0)], [("00:20", 16.0), ("03:30", 32.0)], [("05:00", 64.0)]]
    for i, rows in enumerate(files):
        df = spark.createDataFrame([(f"2024-01-01 {t}:00", "a", v) for t, v in rows], "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "value")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    names = sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime)
    assert len(names) == 5
    table, late = windows.run_bounded(spark, f"{tmp_path}/in", "*.parquet", spark.read.parquet(f"{tmp_path}/in").schema, f"file://{tmp_path}/state")
    got = {r["start"].hour: (r["n"], r["total"]) for r in table.collect()}
    assert got == {0: (2, 3.0), 3: (3, 44.0), 5: (1, 64.0)}
    assert [r["value"] for r in late.collect()] == [16.0]
    assert schema_
