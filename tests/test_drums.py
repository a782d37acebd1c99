import math

import numpy as np
import pytest

from tessitura.functions.scalars import HOP_SECONDS
from tessitura.operators import drums, gridfit, series
from tessitura.sources import audio

BANDS = drums.BANDS
KEYS = ["track", "source"]
SCHEMA = "track string, source string, frame long, kick double, body double, noise double, air double"


def ramp(v, zero, one):
    return 0.0 if v is None or (v - zero) / (one - zero) < 0 else min(1.0, (v - zero) / (one - zero))


def brute_hits(env):
    """The rules in plain loops: (frame, band, class, confidence) before and after coincidences."""
    n = len(env["kick"])
    flux = {b: np.maximum(np.r_[0, np.diff(np.log1p(np.maximum(e, 0)))], 0) for b, e in env.items()}
    total = sum(e.sum() for e in env.values())
    active = [b for b in BANDS if env[b].sum() / total >= 1e-3 and flux[b].max() >= 1 and (flux[b] <= 0.02 * flux[b].max()).mean() >= 0.72]
    found = []
    for b in active:
        x, kept = flux[b], []
        for i in range(1, n - 1):
            if x[i] > np.median(x[max(0, i - 43) : i + 44]) and x[i] >= x[max(0, i - 3) : i + 4].max() and not (kept and i - kept[-1] < 3):
                kept.append(i)
        q = np.quantile(x[kept], 0.9) if kept else 0
        found += [(i, b) for i in kept if q > 0 and x[i] > np.median(x[max(0, i - 43) : i + 44]) + 0.4 * q]
    rows = []
    for i, b in sorted(found):
        later = [j for j, c in found if c == b and j > i]
        end = max(i + 1, min([i + 22, n, *later]))
        part = {c: env[c][i:end].sum() for c in BANDS}
        share = {c: part[c] / sum(part.values()) for c in BANDS}
        head, tail = env[b][i : min(i + 3, end)], env[b][min(i + 3, end) : end]
        decay = None if not len(tail) or head.mean() <= 0 else 100.0 if tail.mean() <= 0 else min(100.0, math.sqrt(head.mean()) / math.sqrt(tail.mean()))
        over = share["air"] / (share["air"] + share["noise"]) if share["air"] + share["noise"] > 0 else None
        shape = {"kick": ramp(share["kick"], 0.6, 0.9), "snare": ramp(share["body"], 0.25, 0.55), "hat": min(ramp(decay, 16, 3), ramp(over, 0.015, 0.06))}
        score = sorted((-shape[c] * drums.AFFINITY[b][k], c) for k, c in enumerate(drums.CLASSES))
        clear = -score[0][0] >= 0.15 and score[1][0] - score[0][0] >= 0.10
        rows.append([i, b, score[0][1] if clear else "unclassified", -score[0][0] if clear else -score[1][0], share, over])
    for r in rows:
        kicked = any(c == "kick" and abs(j - r[0]) < 3 for j, c in found)
        if r[1] in ("noise", "air") and r[2] != "unclassified" and r[4]["kick"] >= 0.6 and kicked and not (r[5] is not None and r[5] >= 0.5):
            r[2] = "unclassified"
    kept = []
    for r in rows:
        twin = next((k for k in kept if k[2] == r[2] and abs(k[0] - r[0]) < 3), None)
        if twin is None:
            kept.append(r)
        elif r[3] > twin[3]:
            kept[kept.index(twin)] = r
    known = [k[0] for k in kept if k[2] != "unclassified"]
    kept = [k for k in kept if k[2] != "unclassified" or all(abs(k[0] - f) >= 3 for f in known)]
    return rows, sorted((k[0], k[2], round(k[3], 9)) for k in kept)


def bursts(seed, n=900):
    """Band energies with sharp hits of several kinds over almost nothing."""
    rng = np.random.default_rng(seed)
    env = {b: rng.random(n) * 1e-4 for b in BANDS}
    for i in range(30, n - 60, 21):
        for b in rng.choice(BANDS, rng.integers(1, 4), replace=False):
            at, tail = i + int(rng.integers(0, 3)), rng.uniform(0.3, 6)
            env[b][at : at + 20] += rng.uniform(3, 60) * np.exp(-np.arange(20) / tail)
    return env


def table(spark, recordings):
    rows = [(t, "drums", i, *(float(e[b][i]) for b in BANDS)) for t, e in recordings.items() for i in range(len(e["kick"]))]
    return spark.createDataFrame(rows, SCHEMA)


def test_hits_against_plain_loops(spark):
    data = {f"r{i}": bursts(i) for i in range(4)} | {"rumble": {b: np.abs(np.sin(np.arange(600) / 3)) * 9 + 1 for b in BANDS}}
    found, _, gate = drums.detect(table(spark, data), KEYS)
    hits = drums.resolve(found, KEYS).collect()
    for t, env in data.items():
        rows, want = brute_hits(env)
        assert sorted((r["frame"], r["cls"], round(r["confidence"], 9)) for r in hits if r["track"] == t) == want
        assert len(want) > 10 or t == "rumble"
    assert {r["refusal"] for r in gate.collect() if r["track"] == "rumble"} <= {"no_transient", "not_sparse"}


def brute_grid(times, x, cycle, anchor):
    """The fit in numpy: (status, steps, anchor, error, contrast, on-grid share)."""
    t, hop = np.array(times), HOP_SECONDS

    def snap(n):
        f = (t - anchor) / cycle * n
        f = (f - np.rint(f)) * 2 * np.pi
        return anchor + np.arctan2(np.sin(f).mean(), np.cos(f).mean()) / (2 * np.pi) * cycle / n

    def profile(at, slots):
        k = np.rint((np.arange(len(x)) * hop - at) / (cycle / slots)).astype(int)
        folded = np.zeros(k.max() + 1)
        np.maximum.at(folded, k[k >= 0], x[k >= 0])
        whole = len(folded) // slots
        return np.median(folded[: whole * slots].reshape(whole, slots), axis=0) if whole >= 2 else np.zeros(slots)

    contrast = {n: 1 - p.mean() / p.max() if p.max() > 0 else 0.0 for n in (16, 12) for p in [profile(snap(n), n)]}
    n = 12 if contrast[12] > contrast[16] * 1.1 else 16
    f = (t - snap(n)) / cycle * n
    error = np.abs(f - np.rint(f)).mean()
    p = profile(snap(n), 4 * n)
    share = p[::4].sum() / p.sum() if p.sum() > 0 else None
    if share is not None and share < 0.5:
        return "not_periodic", n, snap(n), error, contrast[n], share
    if error <= 0.18:
        return "ok", n, snap(n), error, contrast[n], share
    mid, worst = (t.min() + t.max()) / 2, 0
    for half in (t[t <= mid], t[t > mid]):
        g = (half - snap(n)) / cycle * n
        a = (g - np.rint(g)) * 2 * np.pi
        g = g - np.arctan2(np.sin(a).mean(), np.cos(a).mean()) / (2 * np.pi)
        worst = max(worst, np.abs(g - np.rint(g)).mean())
    return "drifting" if worst <= 0.18 else "no_fit", n, snap(n), error, contrast[n], share


def test_grids_against_numpy(spark):
    rng, hop = np.random.default_rng(2), HOP_SECONDS
    times = {"sixteen": [0.3 + k * 0.125 for k in range(0, 320, 2)], "triplets": [0.3 + c * 2 + s / 6 for c in range(20) for s in (1, 2, 4, 5, 7, 8, 10, 11)], "random": sorted(rng.uniform(0, 40, 150)), "drift": [0.3 + k * 0.25 * 1.0017 for k in range(160)]}
    times["unknown"] = times["sixteen"]
    hits, flux, series_of = [], [], {}
    for t, at in times.items():
        x = np.zeros(3600)
        for s in at:  # a rise that spreads over some frames
            for d in range(-6, 7):
                i = int(round(s / hop)) + d
                x[i] = max(x[i], 1 - abs(d) / (7 if t == "triplets" else 1.5))
        series_of[t] = x
        hits += [(t, float(s)) for s in at]
        flux += [(t, "kick", i, float(v)) for i, v in enumerate(x)] + [(t, "air", i, 0.0) for i in range(3600)]
    meta = {t: (2.0, 0.3 if t == "triplets" else None, 0.31 if t == "sixteen" else None) for t in times} | {"unknown": (None, None, None)}
    h = spark.createDataFrame(hits, "track string, t double")
    f = spark.createDataFrame(flux, "track string, band string, frame long, flux double")
    m = spark.createDataFrame([(t, *v) for t, v in meta.items()], "track string, cycle_seconds double, downbeat_seconds double, first_beat_seconds double")
    fitted = gridfit.fit(h, f, m, ["track"])
    got = {r["track"]: r for r in fitted.collect()}
    assert got["unknown"]["grid_status"] == "no_cycle_length" and got["sixteen"]["anchor_source"] == "beats" and got["triplets"]["anchor_source"] == "supplied"
    for t in ("sixteen", "triplets", "random", "drift"):
        cycle, down, beat = meta[t]
        status, n, anchor, error, contrast, share = brute_grid(times[t], series_of[t], cycle, down if down is not None else beat if beat is not None else min(times[t]))
        r = got[t]
        assert (r["grid_status"], r["steps_per_cycle"]) == (status, n if status == "ok" else None)
        assert abs(r["anchor_seconds"] - anchor) < 1e-9 and abs(r["error_steps"] - error) < 1e-9 and abs(r["contrast"] - contrast) < 1e-9
        assert (r["on_grid_share"] is None and share is None) or abs(r["on_grid_share"] - share) < 1e-9
    assert got["sixteen"]["grid_status"] == "ok"
    placed = gridfit.place(h, fitted, ["track"]).collect()
    assert {r["step"] for r in placed if r["track"] == "sixteen"} == set(range(0, 16, 2))
    assert {r["step"] for r in placed if r["track"] == "unknown"} == {None}


@pytest.fixture(scope="module")
def pattern(spark):
    chunks = audio.as_chunks(spark, {("p", "drums"): ("drum_pattern", 120.0, 8.0)})
    return audio.frame_bands(chunks).select(*KEYS, "frame", *BANDS)


def test_pattern_of_a_recording(spark, pattern):
    meta = spark.createDataFrame([("p", "drums", 2.0, 0.25, None), ("gone", "drums", 2.0, None, None)], "track string, source string, cycle_seconds double, downbeat_seconds double, first_beat_seconds double")
    hits, per_class, summary = drums.decompose(pattern, meta, KEYS)
    got = {r["cls"]: (r["hit_count"], r["steps"]) for r in per_class.collect()}
    assert got["kick"][1] == [0, 8] and got["kick"][0] == 16
    assert all(s % 2 == 0 for _, steps in got.values() for s in steps)
    rows = {r["track"]: r for r in summary.collect()}
    assert rows["p"]["status"] == "ok" and rows["p"]["steps_per_cycle"] == 16 and rows["p"]["error_steps"] < 0.18
    assert rows["gone"]["status"] == "too_few_hits" and "no drum hits detected" in rows["gone"]["caveats"]


def test_spaced_rows_keep_the_better_of_a_chain(spark):
    rows = [("t", f, c) for f, c in [(0, 0.5), (2, 0.9), (4, 0.1), (5, 0.2), (20, 0.3), (22, 0.3)]]
    got = series.spaced(spark.createDataFrame(rows, "track string, frame long, confidence double"), 3, ["track"], "confidence").collect()
    assert sorted((r["frame"], r["confidence"]) for r in got) == [(2, 0.9), (5, 0.2), (20, 0.3)]
