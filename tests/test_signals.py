"""Signals whose outcome is known, through the sound pass to notes, hits and descriptors."""

import numpy as np
import pytest

from tessitura.functions.scalars import HOP_SECONDS
from tessitura.operators import analysis, drums, notes
from tessitura.sources import audio, signals

BASS = ["bass_line", "octave_trap", "glide", "unvoiced", "silence"]
DRUMS = ["drum_pattern", "kick_only", "open_hats", "ambiguous"]


def chunks(spark, names, source):
    rows = [(n, source, c, p.tolist(), len(x)) for n in names for x in [audio.to_mono(signals.SIGNALS[n]())] for c, p in audio.chunks(x.astype(np.float32))]
    return spark.createDataFrame(rows, audio.CHUNK)


@pytest.fixture(scope="module")
def lines(spark):
    out = {}
    grid = spark.createDataFrame([(n, 0.25, 0.125, 16, 0.5, 0.25) for n in BASS], "track string, anchor_seconds double, step_seconds double, steps_per_cycle int, beat_period_seconds double, downbeat_seconds double")
    wanted = spark.createDataFrame([(n, False) for n in BASS], "track string, silent boolean")
    for method in audio.ESTIMATORS:
        f0 = audio.pitch(chunks(spark, BASS, "bass"), method).drop("source")
        out[method] = {r["track"]: r["bass_line"] for r in notes.bass_line(f0, grid, wanted, ["track"], HOP_SECONDS).collect()}
    return out


@pytest.mark.parametrize("method", list(audio.ESTIMATORS))
def test_bass_lines(lines, method):
    got = lines[method]
    for name in ("bass_line", "octave_trap"):
        n = got[name]["notes"]
        assert [x["midi"] for x in n] == signals.LINE, name
        assert [x["step"] for x in n] == [0, 4, 8, 12] * 4
        assert all(abs(x["cents"]) < 15 for x in n) and not got[name]["caveats"]
    assert [x["midi"] for x in got["glide"]["notes"]] == [33, 40] * 8
    assert got["unvoiced"]["notes"] == [] and got["unvoiced"]["status"] == "unvoiced"
    assert got["silence"]["notes"] == [] and got["silence"]["status"] == "unvoiced"


def test_drum_patterns(spark):
    frames = audio.frame_bands(chunks(spark, DRUMS, "drums")).select("track", "frame", *drums.BANDS)
    meta = spark.createDataFrame([(n, 2.0, 0.25, None) for n in DRUMS], "track string, cycle_seconds double, downbeat_seconds double, first_beat_seconds double")
    hits, patterns, summary = drums.decompose(frames, meta, ["track"])
    steps = {}
    for r in patterns.collect():
        steps.setdefault(r["track"], {})[r["cls"]] = {s for s, o in zip(r["steps"], r["occupancy"], strict=True) if o >= 0.75}
    status = {r["track"]: (r["status"], r["steps_per_cycle"]) for r in summary.collect()}
    assert set(status.values()) == {("ok", 16)}
    assert steps["drum_pattern"]["kick"] == {0, 8} and steps["drum_pattern"]["snare"] == {4, 12}
    heard = {(r["step"], r["cycle"]) for r in hits.filter("track = 'drum_pattern'").collect()}
    assert heard >= {(s, c) for s in (2, 6, 10, 14) for c in range(4)} and steps["drum_pattern"]["hat"] >= {2, 6, 10}
    assert steps["kick_only"]["kick"] == {0, 4, 8, 12} and not steps["kick_only"].get("snare") and not steps["kick_only"].get("hat")
    assert steps["open_hats"]["kick"] == {0, 8}
    decay = {(r["track"], r["cls"]): r["d"] for r in hits.groupBy("track", "cls").agg(audio.F.percentile("decay", 0.5).alias("d")).collect()}
    loose = hits.filter("track = 'ambiguous' and cls = 'unclassified'").count()
    assert steps["ambiguous"]["kick"] == {0, 8} and loose >= 12  # clicks keep their time without a class
    assert decay["drum_pattern", "hat"] > 3


def test_descriptors_of_tones_and_noises(spark):
    names = ["sine_a440", "white_noise", "pink_noise", "silence"]
    c = chunks(spark, names, "mix")
    wanted = spark.createDataFrame([(n, "mix") for n in names], "track string, source string")
    got = {r["track"]: r for r in analysis.analyse(audio.frame_bands(c), audio.levels(c, ["track", "source"]), wanted).collect()}
    a, w, p, s = (got[n] for n in names)
    assert abs(a["centroid_energy_hz"] - 440) < 3 and abs(a["crest_factor"] - 2**0.5) < 0.01 and a["key"] == "a"
    assert abs(w["centroid_energy_hz"] - 10_000) < 800 and 4 < w["crest_factor"] < 5.5 and w["chroma_entropy"] > 0.97
    assert -24 < p["loudness_lufs"] < -16
    assert s["loudness_lufs"] is None and s["onset_density"] == 0 and all(v is None or isinstance(v, (str, list)) or np.isfinite(v) for v in s.asDict().values())


def test_signals_are_the_same_every_time():
    for make in signals.SIGNALS.values():
        assert np.array_equal(make(), make())
