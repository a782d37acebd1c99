import json

from pyspark.sql import functions as F

from tessitura import session, sinks
from tessitura.operators import notes, vocab
from tessitura.sources import audio


def test_files_by_path_and_half_even_digits(spark, tmp_path):
    df = spark.createDataFrame([("My Song!", "drums", 0.0000005, [1.0000015, 2.0], None), ("My Song!", None, 1.0, [], "x")], "track string, source string, a double, b array<double>, c string")
    out = {r["source"]: r["path"] for r in sinks.write_files(df, f"file://{tmp_path}").collect()}
    assert out == {"drums": f"file://{tmp_path}/my-song/analysis/drums.json", None: f"file://{tmp_path}/my-song/track_summary.json"}
    got = (tmp_path / "my-song" / "analysis" / "drums.json").read_text()
    assert got == '{"a":0.0,"b":[1.000002,2.0],"c":null}' and json.loads((tmp_path / "my-song" / "track_summary.json").read_text()) == {"a": 1.0, "b": [], "c": "x"}


def test_documents_round_trip_and_counts(spark, tmp_path):
    df = spark.createDataFrame([("t", "bass", 1.5, ["a", "b"])], "track string, source string, x double, events array<string>")
    sinks.write_documents(df, f"file://{tmp_path}/docs", ["track", "source"])
    body = df.drop("track", "source").schema
    back = sinks.read_documents(spark, f"file://{tmp_path}/docs", body).select("x", "events").first()
    assert (back["x"], back["events"]) == (1.5, ["a", "b"])
    s = df.select(F.struct("x", "events").alias("d"))
    assert s.select(sinks.counted(F.col("d"), s.schema["d"].dataType, {"events"}).alias("d")).first()["d"].asDict() == {"x": 1.5, "events": 2}
    assert {r["probe"] for r in sinks.doctor(spark).collect()} >= {"python", "spark", "scipy"}


def test_fixtures_round_trip(spark, tmp_path):
    chunks = audio.as_chunks(spark, {("c", "drums"): ("click_train", 120.0, 3.0)})
    audio.write_fixtures(chunks, f"file://{tmp_path}")
    n = 1 + int(3 * 44100) // 512
    assert all(audio.read_fixture(spark, f"file://{tmp_path}", name).count() == n for name in audio.FIXTURES)


def test_notes_on_a_grid(spark):
    hop = 0.01
    n = spark.createDataFrame([(t, f) for t in ("steps", "beat", "free", "none") for f in (0, 26, 130, 410)], "track string, start_frame long")
    grid = spark.createDataFrame([("steps", 0.05, 0.125, 16, None, None), ("beat", None, None, None, 0.5, 0.25), ("free", None, 0.125, None, None, None), ("none", 0.1, None, None, None, None)], "track string, anchor_seconds double, step_seconds double, steps_per_cycle int, beat_period_seconds double, downbeat_seconds double")
    got = {}
    for r in notes.on_grid(n, grid, ["track"], hop).orderBy("track", "start_frame").collect():
        got.setdefault(r["track"], []).append(r["step"])
    step = lambda f, a, s, m: (lambda k: k % m if m else k)(round((f * hop - a) / s))
    frames = (0, 26, 130, 410)
    assert got == {"steps": [step(f, 0.05, 0.125, 16) for f in frames], "beat": [step(f, 0.25, 0.125, 16) for f in frames], "free": [step(f, 0, 0.125, None) for f in frames], "none": [None] * 4}


def test_sounds_of_drums_and_bass_together(spark):
    hits = spark.createDataFrame([("t", "kick", 0.1, 5.0), ("t", "hat", 0.1, 8.0), ("t", "snare", 0.05, 3.0)], "track string, cls string, body double, decay double")
    rows = [("t", 0.9, 0.001, 60.0, False, "ok"), ("h", 0.3, 0.4, 500.0, False, "unvoiced"), ("q", 0.9, 0.001, 60.0, True, "silent"), ("u", 0.6, 0.05, 150.0, None, "not_attempted")]
    bass = spark.createDataFrame(rows, "track string, low double, brightness double, centroid double, silent boolean, status string")
    got = {(r["track"], r["role"]): (r["sound"], r["alternatives"]) for r in vocab.sounds(hits, bass, ["track"]).collect()}
    assert got["t", "kick"] == ("bd", []) and got["t", "snare"] == ("sd", ["cp"]) and got["t", "hat"] == ("hh", [])
    assert got["t", "bass"] == ("sine", []) and got["h", "bass"] == ("sawtooth", ["square"]) and got["q", "bass"] == (None, []) and got["u", "bass"] == (None, vocab.WAVEFORMS)
    s = bass.select("track", vocab.bass_suggestion(*[F.col(c) for c in ("low", "brightness", "centroid", "silent", "status")]).alias("s")).collect()
    why = {r["track"]: r["s"] for r in s}
    assert "unvoiced" in why["h"]["reason"] and why["q"]["match"] == "none" and why["t"]["evidence"]["centroid"] == 60.0


def test_intermediate_tables_can_be_discarded(spark):
    df = session.materialize(spark.range(5), "gone")
    files = df.inputFiles()
    session.discard(df)
    assert files and spark.range(1).count() == 1
    import os

    assert not any(os.path.exists(f.split(":", 1)[1].replace("//", "/")) for f in files)
