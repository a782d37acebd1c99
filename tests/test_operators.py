import numpy as np

from pyspark.sql import functions as F

from tessitura.functions.scalars import num
from tessitura.operators import arrangement, drums, grid, hints, labels, notes, series, tempo, tonal
from tessitura.sources import audio


def frame_table(spark, values, source="s"):
    return spark.createDataFrame([("t", source, i, float(v)) for i, v in enumerate(values)], "track string, source string, frame long, value double")


def test_flux_and_peaks_against_numpy(spark):
    rng = np.random.default_rng(1)
    v = np.abs(rng.standard_normal(300)) + (np.arange(300) % 25 == 10) * 40
    x = np.maximum(np.r_[0, np.diff(np.log1p(v))], 0)
    med = np.array([np.median(x[max(0, i - 43) : i + 44]) for i in range(300)])
    cand = [i for i in range(1, 299) if x[i] > med[i] and x[i] >= x[max(0, i - 3) : i + 4].max()]
    kept = []
    for i in cand:
        if not kept or i - kept[-1] >= 3:
            kept.append(i)
    cand = kept
    q = np.quantile(x[cand], 0.9)
    want = [i for i in cand if x[i] > med[i] + 0.4 * q]
    got = sorted(r["frame"] for r in series.peaks(series.flux(frame_table(spark, v))).collect())
    assert got == want and set(range(10, 300, 25)) <= set(got)


def test_plateau_gives_its_earliest_frame(spark):
    v = [0.0] * 20 + [9.0] + [0.0] * 1 + [9.0] + [0.0] * 20
    assert [r["frame"] for r in series.peaks(series.flux(frame_table(spark, v))).collect()] == [20]


def test_equal_peaks_are_counted_from_the_one_kept(spark):
    v = [0.0] * 20 + [9.0, 0.0, 9.0, 0.0, 9.0, 0.0] + [0.0] * 20
    assert sorted(r["frame"] for r in series.peaks(series.flux(frame_table(spark, v))).collect()) == [20, 24]


def test_presence_of_silence_and_of_the_kick(spark):
    level = {"drums": [0.001, 0.001], "bass": [1.0, 0.1], "kick": [0.5, 0.0], "mute": [0.0, 0.0]}
    rows = [("a", s, i, v) for s, vs in level.items() for i, v in enumerate(vs)] + [("quiet", s, i, 0.0) for s in ("drums", "bass") for i in range(2)]
    got = {(r["track"], r["source"], r["bar"]): (r["present"], r["absent"]) for r in arrangement.presence(spark.createDataFrame(rows, "track string, source string, bar long, level double"), ["track"]).collect()}
    assert got["a", "bass", 0] == (True, False) and got["a", "bass", 1] == (False, False)
    assert got["a", "kick", 0] == (False, True) and got["a", "drums", 0] == (False, True)
    assert all(v == (False, True) for k, v in got.items() if k[0] == "quiet" or k[1] == "mute")


def test_bars_of_frames(spark):
    rng = np.random.default_rng(4)
    hop, period, offset = 512 / 44100, 0.4871, 0.233
    x = {"drums": rng.random(700), "kick": rng.random(690)}
    rows = [("t", s, i, float(v)) for s, vs in x.items() for i, v in enumerate(vs)]
    frames = spark.createDataFrame(rows, "track string, source string, frame long, level double")
    meta = spark.createDataFrame([("t", period, offset), ("none", None, None)], "track string, beat_period_seconds double, downbeat_seconds double")
    got = {(r["source"], r["bar"]): r["level"] for r in arrangement.bar_levels(frames, meta, ["track"], hop).collect()}
    bar = 4 * period
    span = 690 * hop - offset
    n = int(span // bar) + (span % bar >= bar / 2)
    edge = [int(np.rint((offset + b * bar) / hop)) for b in range(n + 1)]
    want = {}
    for b in range(n):
        d, k = x["drums"][edge[b] : min(edge[b + 1], 690)], x["kick"][edge[b] : min(edge[b + 1], 690)]
        want["drums", b], want["kick", b] = np.sqrt((d**2).mean()), np.sqrt(k.mean())
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_runs_split_at_changes_gaps_and_nulls(spark):
    rows = [("t", "s", i, v) for i, v in [(0, "a"), (1, "a"), (3, "a"), (4, None), (5, None), (6, "b")]]
    got = series.runs(spark.createDataFrame(rows, "track string, source string, frame long, v string"), "v").collect()
    assert sorted((r["first"], r["last"], r["v"]) for r in got) == [(0, 1, "a"), (3, 3, "a"), (4, 5, None), (6, 6, "b")]


def test_fold_is_dense_and_drops_the_partial_cycle(spark):
    df = spark.createDataFrame([("k", t, v) for t, v in [(-0.3, 9.0), (0.0, 1.0), (0.26, 2.0), (1.0, 3.0), (1.24, 5.0), (2.1, 7.0)]], "source string, t double, value double")
    got = grid.fold(df, F.col("t"), 1.0, 0.0, 4, "value", ["source"]).collect()
    assert sorted((r["cycle"], r["slot"], r["level"]) for r in got) == [(0, 0, 1.0), (0, 1, 2.0), (0, 2, 0.0), (0, 3, 0.0), (1, 0, 3.0), (1, 1, 5.0), (1, 2, 0.0), (1, 3, 0.0)]


def test_stft_chunks_join_without_seams():
    x = np.random.default_rng(0).standard_normal(400_000).astype(np.float32)
    parts = [audio.power_frames(c) for _, c in audio.chunks(x, 64)]
    whole = audio.power_frames(next(c for _, c in audio.chunks(x, 10_000)))
    assert len(whole) == 1 + len(x) // 512 and np.allclose(np.concatenate(parts), whole, rtol=1e-9)


def test_tempo_of_click_trains_and_refusal_of_noise():
    for bpm in (100, 120, 128.5, 145, 174):
        power = audio.power_frames(next(c for _, c in audio.chunks(audio.click_train(bpm, 60.0), 10_000)))
        e = sum(v for k, v in audio.band_energy(power).items() if k != "tempo")
        flux = np.maximum(np.r_[0, np.diff(np.log1p(e))], 0)
        got = tempo.measure(flux, 512 / 44100, bpm * 1.01)
        assert got["status"] == "refined" and abs(got["bpm"] - bpm) < 0.02
    noise = tempo.measure(np.abs(np.random.default_rng(2).standard_normal(5000)), 512 / 44100, 120.0)
    assert noise["status"] == "coarse" and noise["bpm"] == 120.0
    assert tempo.measure(np.zeros(10), 0.01, float("nan"))["status"] == "unavailable"


def test_octave_arbitration():
    base = (1.0, 0.10, 0.02, True)
    assert tempo.arbitrate([base, (0.5, 0.05, 0.03, True), (2.0, 0.2, 0.01, True)]) == 1.0
    assert tempo.arbitrate([base, (0.5, 0.05, 0.01, True), (2.0, 0.2, 0.01, True)]) == 0.5
    none = (1.0, 0.0, 0.0, False)
    both = [none, (0.5, 0.1, 0.04, True), (2.0, 0.2, 0.02, True)]
    assert tempo.arbitrate(both) == 0.5 and tempo.arbitrate(both, keep_incumbent=True) == 1.0


def test_notes():
    hop = 512 / 44100
    midi = np.repeat([33, 33, 36, 40], 20).astype(float)
    f0 = 440 * 2 ** ((midi - 69) / 12)
    voiced = np.arange(80) % 20 < 17
    prob = np.where(voiced, 0.9, 0.1)
    status, out = notes.segment(f0, voiced, prob, hop)
    assert status == "ok" and [n[2] for n in out] == [33, 33, 36, 40]
    assert notes.segment(f0, np.zeros(80, bool), prob, hop) == ("unvoiced", [])
    assert notes.merge_short([[0, 10, 40], [10, 12, 41], [12, 20, 42]], 5) == [[0, 12, 40], [12, 20, 42]]
    assert notes.merge_short([[0, 10, 40], [10, 12, 50]], 5) == [[0, 10, 40]]


def test_sections(spark):
    s = frozenset
    full, thin, gap = s({"kick", "bass", "other"}), s({"other"}), s({"kick", "other"})
    found = arrangement.merge([thin] * 4 + [full] * 4 + [gap] + [full] * 3 + [thin] * 4 + [full] * 4 + [thin] * 2 + [s()] * 2)
    assert [(a, n) for a, n, _ in found] == [(0, 4), (4, 8), (12, 4), (16, 4), (20, 2), (22, 2)]
    assert arrangement.merge([]) == []
    schema = "track string, start_bar int, length_bars int, active string"
    rows = [("a", a, n, ",".join(sorted(p))) for a, n, p in found]
    rows += [("still", 0, 4, ""), ("apart", 0, 4, "bass"), ("apart", 4, 4, "kick"), ("apart", 8, 4, "bass"), ("back", 0, 4, "bass,kick"), ("back", 4, 4, "other"), ("back", 8, 4, "kick"), ("back", 12, 4, "bass,kick,other")]
    got = {}
    for r in sorted(arrangement.named(spark.createDataFrame(rows, schema), ["track"]).collect(), key=lambda r: r["start_bar"]):
        got.setdefault(r["track"], []).append(r["label"])
        assert r["reason"]
    assert got == {"a": ["intro", "full", "breakdown", "drop", "outro", "silence"], "still": ["silence"], "apart": ["intro", "groove", "outro"], "back": ["intro", "breakdown", "groove", "full"]}


def test_labels_gate_and_order(spark):
    row = dict.fromkeys(labels.DESCRIPTORS)
    make = lambda t, s, **kw: {"track": t, "source": s, **row, **kw}
    schema = "track string, source string, " + ", ".join(f"{d} double" for d in labels.DESCRIPTORS)
    rows = [make("a", "drums", loudness_lufs=-80.0, onset_density=9.0), make("b", "drums", loudness_lufs=-10.0, onset_density=8.5, band_low=0.85, crest_factor=8.0), make("c", "bass", rms_mean=0.5)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = {r["track"]: r["labels"] for r in labels.ordered(labels.label(df, ["track"]), ["track"]).collect()}
    assert got == {"a": ["silent/absent stem=1.0"], "b": ["kick-heavy=1.0", "busy drums=0.5", "percussive=0.0"]}


def test_feel(spark):
    beat, rows = 0.5, []
    for name, gaps in (("straight", [0.25] * 40), ("swung", [1 / 3, 1 / 6] * 20), ("random", list(np.random.default_rng(3).uniform(0.1, 0.9, 40)))):
        rows += [(name, float(t), float(g)) for t, g in zip(np.cumsum(gaps), gaps, strict=True)]
    e = hints.feel_evidence(spark.createDataFrame(rows, "track string, t double, ioi double"), ["track"])
    got = {r["track"]: r["feel"] for r in e.select("track", hints.feel(e, num(beat)).alias("feel")).collect()}
    assert got == {"straight": "straight 8ths", "swung": "swung 8ths", "random": None}


def test_key_of_a_profile(spark):
    rows = [(i, tonal.rotated(tonal.PROFILES[s], i)) for i, s in ((9, "minor"), (0, "major"))] + [(99, [1.0] * 12)]
    got = {r["i"]: (r["key"], r["scale"]) for r in tonal.estimate_key(spark.createDataFrame(rows, "i int, chroma array<double>"), ["i"]).collect()}
    assert got == {9: ("a", "minor"), 0: ("c", "major")}


def test_wav_round_trip_and_errors(spark, tmp_path):
    import wave

    x = (np.sin(np.arange(4410) / 10) * 20000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(44100)
        w.writeframes(np.column_stack((x, x)).tobytes())
    (tmp_path / "b.wav").write_bytes(b"no sound")
    got = {r["path"].rsplit("/", 1)[1]: r for r in audio.read_wav(spark, f"file://{tmp_path}").collect()}
    assert np.allclose(got["a.wav"]["samples"], x / 32768, atol=1e-6) and got["a.wav"]["channels"] == 2
    assert got["b.wav"]["samples"] is None and "WAV" in got["b.wav"]["error"]
    y = audio.resample(np.sin(2 * np.pi * 440 * np.arange(22050) / 22050), 22050)
    assert abs(np.abs(np.fft.rfft(y)).argmax() - 440) <= 1


def test_loudness():
    t = np.arange(44100 * 3) / 44100
    assert abs(audio.loudness(np.sin(2 * np.pi * 997 * t)) + 3.01) < 0.1
    assert audio.loudness(np.zeros(44100)) is None and audio.loudness(t[:100]) is None
    f0, conf = audio.yin(np.sin(2 * np.pi * 110 * t[:22050]))
    assert abs(np.nanmedian(f0[10:-10]) - 110) < 1 and conf[20] > 0.8
