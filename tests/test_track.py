"""A folder of sound becomes nested documents of sources and tracks."""

import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura import sinks
from tessitura.operators import analysis, hints, track
from tessitura.sources import audio

BPM, SECONDS, FIRST = 120.0, 34, 0.25


def save(path, x):
    path.parent.mkdir(exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(44100)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())


def bass() -> np.ndarray:
    """A note a beat, a1 and c2 by turns, each of 0.35 s, from the first downbeat on."""
    out = np.zeros(SECONDS * 44100)
    for k in range(60):
        n, at = int(0.35 * 44100), int((FIRST + k * 0.5) * 44100)
        t = np.arange(n) / 44100
        out[at : at + n] += 0.5 * np.sin(2 * np.pi * (55.0 if k % 2 == 0 else 65.406) * t) * np.minimum(1, (n - np.arange(n)) / 400)
    return out


@pytest.fixture(scope="module")
def analysed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tracks")
    d = audio.drum_pattern(BPM, 16, FIRST)
    d = np.r_[d, np.zeros(max(0, SECONDS * 44100 - len(d)))][: SECONDS * 44100]
    t = np.arange(SECONDS * 44100) / 44100
    chord = sum(np.sin(2 * np.pi * f * t) for f in (220.0, 261.63, 329.63)) / 8
    chord[: int(8.25 * 44100)] = 0  # enters after four bars
    save(root / "song" / "drums.wav", d * 0.7)
    save(root / "song" / "bass.wav", bass())
    save(root / "song" / "other.wav", chord)
    save(root / "song" / "mix.wav", (d * 0.7 + bass() + chord) / 3)
    save(root / "calm" / "drums.wav", np.random.default_rng(1).standard_normal(12 * 44100) * 1e-5)
    save(root / "calm" / "mix.wav", np.sin(2 * np.pi * 220 * t[: 12 * 44100]) * 0.3)
    save(root / "calm" / "bass.wav", np.zeros(12 * 44100))
    (root / "calm" / "other.wav").write_bytes(b"no sound")
    chunks = audio.wav_chunks(audio.read_wav(spark, f"file://{root}"))
    wanted = analysis.expected(spark.createDataFrame([("song",), ("calm",)], "track string"))
    sources, tracks = track.from_sound(audio.frame_bands(chunks), audio.pitch(chunks), audio.levels(chunks, ["track", "source"]), wanted)
    return sources.cache(), tracks.cache()


def test_the_track(analysed):
    rows = {r["track"]: r for r in analysed[1].collect()}
    t, d, a = (rows["song"][c] for c in ("tempo", "downbeat", "arrangement"))
    assert t["source"] == "drums" and t["is_drums"] and t["status"] == "refined" and abs(t["bpm"] - BPM) < 0.05
    assert t["octave_fits"] is None or {f["ratio"] for f in t["octave_fits"]} >= {1.0}
    assert abs((d["offset_seconds"] - FIRST + 1) % 2 - 1) < 0.06 or d["status"] == "ambiguous"
    assert a["status"] == "ok" and a["bar_count"] in (16, 17) and abs(a["bar_seconds"] - 2) < 0.01
    first, later = a["sections"][0], a["sections"][1]
    assert first["label"] == "intro" and first["length_bars"] == 4 and "other" not in first["active"] and "other" in later["active"]
    assert abs(later["start_seconds"] - first["start_seconds"] - 8) < 0.05 and all(s["reason"] for s in a["sections"])
    quiet = rows["calm"]
    assert quiet["tempo"]["source"] == "mix" and not quiet["tempo"]["is_drums"] and quiet["tempo"]["octave_fits"] is None
    assert quiet["arrangement"]["status"] == "no_grid" and quiet["arrangement"]["sections"] == [] and quiet["arrangement"]["caveats"]


def test_the_sources(analysed):
    rows = {(r["track"], r["source"]): r for r in analysed[0].collect()}
    assert len(rows) == 10
    d, b = rows["song", "drums"]["drum_decomposition"], rows["song", "bass"]["bass_line"]
    assert d["status"] == "ok" and d["steps_per_cycle"] == 16 and abs(d["cycle_seconds"] - 2) < 0.01
    assert [h["seconds"] for h in d["hits"]] == sorted(h["seconds"] for h in d["hits"]) and [p["cls"] for p in d["patterns"]] == [c for c in track.ORDER if c in {p["cls"] for p in d["patterns"]}]
    kicks = {h["step"] for h in d["hits"] if h["cls"] == "kick"}
    assert len(kicks) == 2 and (max(kicks) - min(kicks)) == 8  # every half cycle
    assert b["status"] == "ok" and {n["midi"] for n in b["notes"]} == {33, 36} and len(b["notes"]) >= 55
    on_beat = np.array([n["step"] for n in b["notes"]])
    assert np.isin((on_beat - min(kicks)) % 4, (0, 1)).mean() > 0.9  # the drums' own grid, onsets found a little late
    assert [n["start_seconds"] for n in b["notes"]] == sorted(n["start_seconds"] for n in b["notes"])
    assert rows["song", "vocals"]["status"] == "missing" and rows["song", "mix"]["drum_decomposition"] is None and rows["song", "mix"]["rhythm"]["bpm"] is not None
    assert rows["calm", "drums"]["drum_decomposition"]["status"] == "silent" and rows["calm", "bass"]["bass_line"]["status"] == "silent"
    assert any(x.startswith("bass_line (status=silent)") for x in rows["calm", "bass"]["unavailable_features"])
    assert any(x.startswith("source (silent") for x in rows["calm", "drums"]["unavailable_features"]) and rows["calm", "other"]["status"] == "missing"
    assert rows["calm", "drums"]["labels"][0].startswith("silent") and rows["calm", "vocals"]["labels"] == []


def test_documents(spark, analysed, tmp_path):
    root = f"file://{tmp_path}"
    written = sinks.write_files(analysed[0], root).collect() + sinks.write_files(analysed[1].withColumn("source", F.lit(None).cast("string")), root).collect()
    assert len(written) == 12
    doc = json.loads((tmp_path / "song" / "analysis" / "drums.json").read_text())
    assert doc["drum_decomposition"]["status"] == "ok" and len(doc["drum_decomposition"]["hits"]) > 100
    summary = json.loads((tmp_path / "song" / "track_summary.json").read_text())
    assert abs(summary["tempo"]["bpm"] - BPM) < 0.05 and summary["arrangement"]["sections"][0]["label"] == "intro"


def test_grid_source_and_bass_grid(spark):
    rows = [("a", "drums", 0.1), ("a", "mix", 0.2), ("b", "drums", 1e-5), ("b", "mix", 0.2), ("c", "bass", 0.2), ("d", "mix", None)]
    got = {r["track"]: (r["source"], r["is_drums"]) for r in track.grid_source(spark.createDataFrame(rows, "track string, source string, rms double")).collect()}
    assert got == {"a": ("drums", True), "b": ("mix", False), "c": (None, False), "d": (None, False)}


def test_hints(analysed):
    got = {r["track"]: r["hints"] for r in hints.assemble(analysed[1], analysed[0]).collect()}
    h = got["song"]
    assert abs(h["bpm"] - BPM) < 0.05 and abs(h["suggested_cycle_seconds"] - 2) < 0.01 and h["tempo_status"] == "refined"
    mix, bass_ = ({(r["track"], r["source"]): r for r in analysed[0].collect()}["song", s]["tonal"] for s in ("mix", "bass"))
    sure = [t for t in (mix, bass_) if t["key_confidence"] >= hints.CENTRE_MIN["profile_lead"]]
    assert h["tonal_centre"] == (f"{sure[0]['key']} {sure[0]['scale']}" if sure else None)
    assert h["drum_density"] in ("moderate", "busy") and h["bass_activity"] == "moderate" and h["subdivision_feel"] == "straight 8ths"
    assert h["drum_grid"]["status"] == "ok" and len(h["drum_grid"]["kick_steps"]) == 2 and h["drum_grid"]["steps_per_cycle"] == 16
    assert h["bass_line"]["note_sequence"][:4] == ["a1", "c2", "a1", "c2"] and h["bass_line"]["truncated_from"] >= 55 and abs(sum(h["bass_line"]["step_share"]) - 1) < 0.01
    assert h["arrangement"]["sections"][0].startswith("bar 0 x4 intro") and {s["role"] for s in h["sound_suggestions"]} >= {"kick", "bass"}
    assert {s["role"]: s["sound"] for s in h["sound_suggestions"]}["kick"] == "bd"
    calm = got["calm"]
    assert calm["drum_density"] is None and calm["bass_line"]["status"] == "silent" and calm["arrangement"] is None and calm["subdivision_feel"] is None
    said = " ".join(calm["notes"])
    assert "drums are below the silence floor" in said and "arrangement's status is no_grid" in said
