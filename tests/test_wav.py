"""Sound by byte ranges, and what comes out of chunks against whole recordings."""

import struct
import wave

import numpy as np
import pytest

from tessitura.sources import audio, wav


def save(path, x, rate=44100, width=2):
    path.parent.mkdir(parents=True, exist_ok=True)
    x = np.atleast_2d(np.asarray(x).T).T
    with wave.open(str(path), "wb") as w:
        w.setnchannels(x.shape[1]), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())


def written(x):
    return (np.clip(x, -1, 1) * 32767).astype("<i2").astype(np.float32) / 32768


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(0)
    n = 3 * audio.CHUNK_FRAMES * audio.HOP + 70_001
    return rng.standard_normal(n) * 0.1 * (1 + np.sin(np.arange(n) / 20000))


def rows_of(df):
    return {(r["track"], r["source"], r["chunk"]): r for r in df.collect()}


@pytest.mark.parametrize("size", [100_000, 1 << 30])
def test_byte_ranges_give_the_chunks_of_the_whole(spark, tmp_path, noise, size):
    save(tmp_path / "a" / "mix.wav", noise)
    save(tmp_path / "b" / "bass.wav", np.stack([noise[:200_000], -noise[:200_000] / 2], axis=1))
    save(tmp_path / "c" / "other.wav", noise[:90_000], rate=22050)
    save(tmp_path / "d" / "none.wav", noise[:0])
    df = wav.read_chunks(spark, f"file://{tmp_path}", size)
    assert df.rdd.getNumPartitions() > (15 if size < 1 << 20 else 3)
    got = rows_of(df)
    half = np.stack([written(noise[:200_000]), written(-noise[:200_000] / 2)], axis=1)
    whole = {("a", "mix"): written(noise), ("b", "bass"): audio.to_mono(half), ("c", "other"): audio.resample(written(noise[:90_000]), 22050), ("d", "none"): np.zeros(0, np.float32)}
    want = {(*k, c): part for k, x in whole.items() for c, part in audio.chunks(x)}
    assert set(got) == set(want)
    for k, part in want.items():
        assert got[k]["total"] == len(whole[k[:2]]) and np.allclose(got[k]["samples"], part, atol=1e-7)
    padded = np.r_[np.zeros(audio.BEFORE), whole["a", "mix"], np.zeros(audio.AFTER + 2048)]
    for c in range(3):
        start, stop = audio.chunk_span(c, len(noise))
        assert np.allclose(got["a", "mix", c]["before"], padded[max(0, start) : start + audio.BEFORE] if start >= 0 else np.r_[np.zeros(1024), padded[: start + audio.BEFORE + 1024 - 1024]][-audio.BEFORE :], atol=1e-7)
        assert np.allclose(got["a", "mix", c]["after"], padded[stop + audio.BEFORE : stop + audio.BEFORE + audio.AFTER], atol=1e-7)


def test_unreadable_files_are_rows_with_an_error(spark, tmp_path, noise):
    save(tmp_path / "t" / "mix.wav", noise[:50_000])
    (tmp_path / "t" / "bass.wav").write_bytes(b"broken")
    (tmp_path / "t" / "empty.wav").write_bytes(b"")
    (tmp_path / "t" / "odd.wav").write_bytes(b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 2, 1, 44100, 1, 1, 4) + b"data\x04\0\0\0abcd")
    whole = (tmp_path / "t" / "mix.wav").read_bytes()
    (tmp_path / "t" / "torn.wav").write_bytes(whole[:50_001])
    got = wav.read_chunks(spark, f"file://{tmp_path}").collect()
    assert {r["source"] for r in got if r["error"]} == {"bass", "empty", "odd"} and all(r["chunk"] is None for r in got if r["error"])
    assert {r["source"]: r["total"] for r in got if not r["error"]} == {"mix": 50_000, "torn": (50_001 - 44) // 2}


@pytest.mark.parametrize("method", ["yin", "yinfft"])
def test_pitch_doesnt_depend_on_chunks(spark, tmp_path, method):
    t = np.arange(3 * audio.CHUNK_FRAMES * audio.HOP + 9_000) / 44100
    x = 0.5 * np.sin(2 * np.pi * 55 * t) + 0.2 * np.sin(2 * np.pi * 110 * t)
    save(tmp_path / "a" / "bass.wav", x)
    f0, confidence = audio.yin(written(x), method)
    plain = spark.createDataFrame([("a", "bass", c, p.tolist()) for c, p in audio.chunks(written(x))], "track string, source string, chunk long, samples array<float>")
    for chunks in (wav.read_chunks(spark, f"file://{tmp_path}", 200_000), plain):
        got = sorted((r["frame"], r["f0_hz"], r["voiced_prob"], r["voiced"]) for r in audio.pitch(chunks, method).collect())
        assert [g[0] for g in got] == list(range(len(f0)))
        assert np.allclose([g[1] for g in got], f0, atol=1e-4) and np.allclose([g[2] for g in got], confidence, atol=1e-5)
        inside = got[6:-8]
        assert all(g[3] and abs(g[1] - 55) < 0.4 for g in inside)


def test_pitch_methods_by_range_and_noise():
    t = np.arange(44100) / 44100
    for hz in (35.0, 82.41, 196.0, 350.0):
        for method in audio.ESTIMATORS:
            f0, confidence = audio.yin(np.sin(2 * np.pi * hz * t), method)
            assert abs(np.median(f0[8:-8]) - hz) < 0.02 * hz and np.median(confidence[8:-8]) > 0.7
    hiss = np.random.default_rng(1).standard_normal(44100)
    assert all(np.mean(audio.yin(hiss, m)[1] >= audio.PITCH_MIN) < 0.1 for m in audio.ESTIMATORS)
    assert all(np.isnan(audio.yin(np.zeros(5000), m)[0]).all() for m in audio.ESTIMATORS)


def filtered(x):
    """The two filters sample by sample."""
    for gain, q, fc in (audio.SHELF, audio.HIGH_PASS):
        k = np.tan(np.pi * fc / 44100)
        v = 10 ** (gain / 20)
        vb = v**0.4996667741545416
        n = 1 + k / q + k * k
        b = (v + vb * k / q + k * k, 2 * (k * k - v), v - vb * k / q + k * k) if gain else (n, -2 * n, n)
        a = (n, 2 * (k * k - 1), 1 - k / q + k * k)
        y, x1, x2, y1, y2 = np.zeros(len(x)), 0.0, 0.0, 0.0, 0.0
        for i, s in enumerate(x):
            y[i] = (b[0] * s + b[1] * x1 + b[2] * x2 - a[1] * y1 - a[2] * y2) / a[0]
            x1, x2, y1, y2 = s, x1, y[i], y1
        x = y
    return x


def test_filters_remember_nothing_beyond_the_halo(noise):
    x = noise[:60_000]
    assert np.allclose(audio.weighted(x), filtered(x), atol=1e-12)
    late = audio.weighted(x[30_000 - audio.BEFORE :])[audio.BEFORE :]
    assert np.allclose(late, filtered(x)[30_000:], atol=1e-12)


def test_levels_of_chunks_against_the_whole(spark, tmp_path, noise):
    quiet = np.r_[noise[:300_000] * 0.001, noise]
    save(tmp_path / "a" / "mix.wav", quiet)
    save(tmp_path / "b" / "mix.wav", noise[:10_000])
    save(tmp_path / "c" / "mix.wav", np.zeros(60_000))
    plain = spark.createDataFrame([("a", "mix", c, p.tolist(), len(quiet)) for c, p in audio.chunks(written(quiet))], audio.CHUNK)
    keys = ["track", "source"]
    got = {r["track"]: r for r in audio.levels(wav.read_chunks(spark, f"file://{tmp_path}", 150_000), keys).collect()}
    x = written(quiet).astype(float)
    for r in (got["a"], audio.levels(plain, keys).first()):
        assert abs(r["lufs"] - audio.loudness(x)) < 1e-9 and abs(r["peak"] - np.abs(x).max()) < 1e-9
        assert abs(r["crest"] - np.abs(x).max() / np.sqrt((x**2).mean())) < 1e-9 and abs(r["seconds"] - len(x) / 44100) < 1e-9
    assert got["b"]["lufs"] is None and got["b"]["peak"] > 0
    assert got["c"]["lufs"] is None and got["c"]["crest"] is None and got["c"]["peak"] == 0


def test_a_recording_is_written_in_parts(spark, tmp_path, monkeypatch):
    import numpy as np
    import pyarrow as pa

    values = np.linspace(-1, 1, 50)
    table = pa.table({"track": ["t"] * 50, "source": ["s"] * 50, "i": range(50), "value": values})
    most, hold, repeat = [], 256, np.repeat

    class Rows:
        def select(self, *_):
            return self

        def groupBy(self, *_):
            return self

        def applyInArrow(self, run, _):
            return run

    monkeypatch.setattr(wav, "WRITE_SAMPLES", 1024, raising=False)
    monkeypatch.setattr(np, "repeat", lambda x, n: most.append(len(x) * n) or repeat(x, n))
    out = wav.write_recordings(Rows(), f"file://{tmp_path}", hold)((pa.scalar("t"), pa.scalar("s")), table)
    raw = (tmp_path / "t" / "s.wav").read_bytes()
    assert max(most) <= 1024 and out.column("total").to_pylist() == [50 * hold]
    assert raw[44:] == repeat(np.rint(values * 32767).astype("<i2"), hold).tobytes() and len(raw) == 44 + 100 * hold


def test_recordings_are_read_by_few_tasks_and_named_as_they_are_read_back(spark):
    from tessitura.plans import sound

    e = spark.range(9000).selectExpr("id event_id", "timestamp_ntz'2024-01-02 00:00:00' ts", "if(id < 8990, 'view', null) event_type", "cast(id % 100 as double) value")
    chunks, written = sound.sound_of(spark, e)
    assert chunks.rdd.getNumPartitions() == 2  # two recordings, of 4.6 MB and less
    names = {tuple(r) for r in written.select("track", "source").collect()}
    assert names == {tuple(r) for r in chunks.select("track", "source").distinct().collect()} == {("week0", "view"), ("week0", "None")}


def test_loudness_filters_by_a_short_transform():
    x = np.random.default_rng(1).standard_normal(audio.BEFORE + 50000)
    assert np.allclose(audio.weighted_after(x), audio.weighted(x)[audio.BEFORE :], atol=1e-12)
