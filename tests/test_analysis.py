import wave

import numpy as np
import pytest

from tessitura.functions.scalars import HOP_SECONDS
from tessitura.operators import analysis, rhythm, series
from tessitura.sources import audio


CHORD = sum(np.sin(2 * np.pi * f * np.arange(44100 * 9) / 44100) for f in (220.0, 261.63, 329.63)) / 4


def save(path, x):
    path.parent.mkdir(exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(44100)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("sound")
    t = np.arange(44100 * 9) / 44100
    save(root / "one" / "drums.wav", audio.click_train(120.0, 20.0) * 0.8)
    save(root / "one" / "bass.wav", np.sin(2 * np.pi * 110 * t) * 0.5)
    save(root / "one" / "other.wav", CHORD)
    save(root / "two" / "mix.wav", np.zeros(44100 * 2))
    (root / "two" / "bass.wav").write_bytes(b"broken")
    return f"file://{root}"


def test_a_folder_of_sound_becomes_descriptors(spark, folder):
    wavs = audio.read_wav(spark, folder)
    chunks = audio.wav_chunks(wavs)
    wanted = analysis.expected(spark.createDataFrame([("one",), ("two",)], "track string"))
    got = {(r["track"], r["source"]): r for r in analysis.analyse(audio.frame_bands(chunks), audio.levels(chunks, ["track", "source"]), wanted).collect()}
    assert len(got) == 10 and {k for k, r in got.items() if r["status"] == "ok"} == {("one", "drums"), ("one", "bass"), ("one", "other"), ("two", "mix")}
    d, b, o, s = got["one", "drums"], got["one", "bass"], got["one", "other"], got["two", "mix"]
    assert abs(d["bpm"] - 120) < 0.5 and abs(d["onset_density"] - 2) < 0.15 and d["transient_sharpness"] > 10
    assert abs(b["centroid_energy_hz"] - 110) < 3 and b["band_low"] > 0.99 and abs(b["crest_factor"] - 2**0.5) < 0.02 and b["onset_density"] < 0.5 and b["bpm"] is None
    assert (o["key"], o["scale"]) == ("a", "minor") and o["chroma_entropy"] < 0.8
    # the stability again in numpy, from the samples as they were written
    x = np.r_[np.zeros(1024), np.floor(np.abs(CHORD) * 32767) * np.sign(CHORD) / 32768, np.zeros(2048)]
    c = audio.pitch_classes(audio.power_frames(x.astype(np.float32))[: 1 + len(CHORD) // 512])
    cosine = (c[1:] * c[:-1]).sum(1) / np.linalg.norm(c[1:], axis=1) / np.linalg.norm(c[:-1], axis=1)
    assert abs(o["tonal_stability"] - cosine.mean()) < 1e-6
    assert s["onset_density"] == 0 and s["rms_mean"] == 0 and s["band_low"] is None and "spectral.band_low" in s["unavailable_features"]
    missing = got["two", "bass"]
    assert missing["status"] == "missing" and "rhythm.onset_density" in missing["unavailable_features"] and missing["unavailable_features"] == sorted(missing["unavailable_features"])


def test_frame_statistics_against_numpy(spark):
    x = np.random.default_rng(0).standard_normal(60_000).astype(np.float32)
    rows = [("t", "s", c, part.tolist()) for c, part in audio.chunks(x)]
    frames = audio.frame_bands(spark.createDataFrame(rows, "track string, source string, chunk long, samples array<float>"))
    r = analysis.spectral(frames).first()
    power = audio.power_frames(np.r_[np.zeros(1024), x, np.zeros(2048)])[: 1 + len(x) // 512]
    mag, f = np.sqrt(power), np.arange(1025) * 44100 / 2048
    centroid = (mag @ f) / mag.sum(1)
    roll = f[(np.cumsum(mag, 1) >= 0.85 * mag.sum(1)[:, None]).argmax(1)]
    inside = (f >= 20) & (f <= 20000)
    assert np.isclose(r["centroid_mean"], centroid.mean()) and np.isclose(r["centroid_std"], centroid.std()) and np.isclose(r["rolloff_mean"], roll.mean())
    assert np.isclose(r["brightness"], power[:, inside & (f >= 1500)].sum() / power[:, inside].sum())
    assert np.isclose(r["centroid_energy_hz"], (power[:, inside] @ f[inside]).sum() / power[:, inside].sum())


def test_beats_and_pitch_of_chunks(spark):
    frames = audio.frame_bands(audio.as_chunks(spark, {("c", "drums"): ("click_train", 100.0, 20.0)}))
    tempos = rhythm.coarse_tempo(frames, ["track", "source"], HOP_SECONDS)
    assert abs(tempos.first()["bpm"] - 100) < 0.3
    times = np.array(sorted(r["t"] for r in rhythm.beats(frames, tempos, ["track", "source"], HOP_SECONDS).collect()))
    clicks = 0.25 + np.arange(32) * 0.6
    assert all(np.abs(times - c).min() < 0.05 for c in clicks)
    t = np.arange(44100 * 8) / 44100
    rows = [("b", "bass", c, part.tolist()) for c, part in audio.chunks(np.sin(2 * np.pi * 82.41 * t).astype(np.float32))]
    got = audio.pitch(spark.createDataFrame(rows, "track string, source string, chunk long, samples array<float>")).collect()
    assert sorted(r["frame"] for r in got) == list(range(1 + len(t) // 512))
    near = [r for r in got if r["voiced"] and abs(r["f0_hz"] - 82.41) < 1]
    assert len(near) > 0.95 * len(got)
    assert series.flux(frames, "power", ["track", "source"]).count() == 1 + int(20 * 44100) // 512
