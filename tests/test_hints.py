import random

import pytest
from pyspark.sql import functions as F

from tessitura.functions.scalars import num
from tessitura.operators import analysis, gridfit, hints, tempo


@pytest.mark.parametrize("keep", [False, True])
def test_arbitration_of_many_tracks_equals_that_of_one(spark, keep):
    rng, rows, want = random.Random(3), [], {}
    for t in range(120):
        errors = [(r, round(rng.uniform(0.05, 0.2), 3), round(rng.uniform(0.01, 0.05), 3), rng.random() < 0.7) for r in (0.5, 1.0, 2.0)]
        rows += [(t, r, 100 * r, g, s if g else None, e if g else None) for r, s, e, g in errors]
        want[t] = tempo.arbitrate(errors, keep_incumbent=keep)
    fits = spark.createDataFrame(rows, "track int, ratio double, bpm double, grid boolean, error_steps double, error_seconds double")
    got = {r["track"]: r for r in tempo.arbitrate_octave(fits, ["track"], keep).collect()}
    assert {t: r["ratio"] for t, r in got.items()} == want and set(want.values()) == {0.5, 1.0, 2.0}
    assert all(r["bpm"] == 100 * r["ratio"] and (r["caveat"] is None) == (r["ratio"] == 1) for r in got.values())
    assert all(("without comparison" in r["caveat"]) == (not r["compared"]) for r in got.values() if r["caveat"])


def test_the_octave_of_a_grid(spark):
    """Hits on the eighths of 120 BPM: a coarse tempo of 90 finds no grid, its candidates are tried as given."""
    times = [0.2 + k * 0.25 for k in range(160)]
    hits = spark.createDataFrame([("a", t) for t in times], "track string, t double")
    x = [0.0] * 3600
    for t in times:
        x[round(t * 44100 / 512)] = 1.0
    flux = spark.createDataFrame([("a", "kick", i, v) for i, v in enumerate(x)], "track string, band string, frame long, flux double")
    cand = spark.createDataFrame([("a", 0.5, 60.0, True), ("a", 1.0, 120.0, True), ("a", 2.0, 240.0, False)], "track string, ratio double, bpm double, live boolean")
    fits = {r["ratio"]: r for r in tempo.octave_fits(hits, flux, cand, ["track"]).collect()}
    assert set(fits) == {0.5, 1.0} and fits[1.0]["grid"] and fits[1.0]["error_steps"] < 0.01
    assert gridfit.CANDIDATES == (16, 12)


def test_hints_of_a_drum_grid_and_a_bass_line(spark):
    summary = spark.createDataFrame([("a", "ok", 16, 2, ["x"]), ("b", "no_grid", None, 0, [])], "track string, status string, steps_per_cycle int, unclassified long, caveats array<string>")
    patterns = spark.createDataFrame([("a", "kick", [0, 8]), ("a", "hat", [2])], "track string, cls string, steps array<long>")
    got = {r["track"]: r for r in hints.drum_grid_hint(summary, patterns, ["track"]).collect()}
    assert got["a"]["drum_grid"]["kick_steps"] == [0, 8] and got["a"]["drum_grid"]["snare_steps"] == [] and got["a"]["note"] is None
    assert got["b"]["drum_grid"]["steps_per_cycle"] is None and "no_grid" in got["b"]["note"]
    rows = [("a", "ok", i, 33 + i % 3, (i % 4) * 4 if i % 5 else None) for i in range(40)] + [("b", "unvoiced", None, None, None)]
    line = {r["track"]: r for r in hints.bass_line_hint(spark.createDataFrame(rows, "track string, status string, note int, midi int, step long"), ["track"]).collect()}
    a = line["a"]["bass_line"]
    assert a["note_sequence"][:4] == ["a1", "a#1", "b1", "a1"] and len(a["note_sequence"]) == 32 and a["truncated_from"] == 40 and a["median_midi_note"] == 34
    placed = [r[4] for r in rows if r[4] is not None]
    assert a["steps"] == [0, 4, 8, 12] and a["step_share"] == [round(placed.count(s) / len(placed), 4) for s in a["steps"]]
    assert line["b"]["bass_line"]["note_sequence"] == [] and "unvoiced" in line["b"]["note"]


def test_notes_centres_and_tempos(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    null = F.lit(None).cast("double")
    assert value(hints.reported_bpm(null, num(90), num(120)))["value"] == 90 and value(hints.grid_bpm(null, num(120), num(90))) == 120
    assert "unknown" in value(hints.reported_bpm(null, num(0), null))["note"] and value(hints.reported_bpm(num(100), num(90), null))["note"] is None
    side = lambda key, c, present=True, silent=False: {"key": F.lit(key), "scale": F.lit("minor"), "confidence": num(c), "present": F.lit(present), "silent": F.lit(silent)}
    assert value(hints.centre_hint(side("a", 0.6), side("e", 0.9)))["value"] == "a minor"
    assert value(hints.centre_hint(side("a", 0.1), side("e", 0.9)))["value"] == "e minor"
    assert value(hints.centre_hint(side("a", 0.1), side("e", 0.9, silent=True)))["value"] is None
    assert value(hints.centre_hint(side("a", 0.1), side("e", 0.0), "profile_correlation"))["value"] == "a minor"
    assert value(hints.density_hint(num(6), F.lit(True), F.lit(True), "drums"))["value"] is None
    assert value(hints.tempo_note(F.lit("refined"), F.lit("high"), num(0.6))) is None and "weak" in value(hints.tempo_note(F.lit("refined"), F.lit("low"), num(0.2)))
    none = F.array().cast("array<double>")
    assert value(hints.octave_note(F.lit("single"), null, F.lit(True), none)) is None
    assert "without comparison" in value(hints.octave_note(F.lit("ambiguous"), num(0.5), F.lit(False), none))
    assert "240.00" in value(hints.octave_note(F.lit("ambiguous"), null, F.lit(True), F.array(num(240))))
    bare = F.array(*[F.struct(F.lit(s).alias("source"), F.lit("ok").alias("status"), F.lit(n).alias("events")) for s, n in (("drums", 0), ("bass", 4))])
    assert value(hints.stripped_note(bare)).endswith("drums")
    assert value(hints.notes(F.lit("x"), F.lit(None).cast("string"), F.lit("y"), F.lit("x"))) == ["x", "y"]
    assert value(hints.section_line(F.lit(4), F.lit(8), F.lit(None).cast("string"), F.array().cast("array<string>"))) == "bar 4 x8 unlabelled: nothing playing"
    assert value(analysis.unavailable({"a": []}, {"drums": F.lit("no_grid"), "bass": F.lit("not_attempted")})) == ["drums (status=no_grid)"]


def test_nested_paths_of_what_is_missing(spark):
    df = spark.createDataFrame([((1.0, None, []), ((None, 2), ["x"])), (None, ((3.0, None), None))], "a struct<x: double, y: string, z: array<int>>, b struct<c: struct<d: double, e: int>, f: array<string>>")
    got = [r[0] for r in df.select(analysis.unavailable_in(df, ["a", "b"])).collect()]
    assert got == [["a.y", "a.z", "b.c.d"], ["a.x", "a.y", "a.z", "b.c.e", "b.f"]]
