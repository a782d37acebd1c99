import numpy as np

from tessitura.operators import downbeat

HOP = 512 / 44100


def brute(low, bright, period, beats=4):
    """The rules in plain loops: (status, slot, beat offset in frames, beat and phase confidence, scores)."""
    flux = np.maximum(np.r_[0, np.diff(np.log1p(np.maximum(low, 0)))], 0)
    beat, n = period / HOP, len(low)
    offsets = max(1, round(beat))
    scores = np.zeros(offsets)
    for o in range(offsets):
        i = np.rint(o + np.arange(int((n - 1 - o) / beat) + 1) * beat).astype(int)
        scores[o] = flux[i[i < n]].mean()
    at, contrast = int(scores.argmax()), max(0.0, 1 - scores.mean() / scores.max())

    def energy(env):
        out = [[] for _ in range(beats)]
        for k in range(int((n * HOP - at * HOP) / period)):
            s = round((at * HOP + k * period) / HOP)
            if s + 5 <= n:
                out[k % beats].append(env[s : s + 5].max())
        return np.array([np.median(v) if v else 0.0 for v in out])

    offs = at * HOP + np.arange(beats) * period
    onset = np.flatnonzero(flux >= 0.2 * flux.max())[0] * HOP
    bar = period * beats
    near = int(np.argmin([min((onset - c) % bar, (c - onset) % bar) for c in offs])) if onset <= 4 * bar else None
    lo, hi = energy(low), energy(bright)
    if bright.sum() / low.sum() < 1e-3 or hi.sum() <= 0:
        return "ambiguous", near or 0, at, contrast, 0.0, np.zeros(beats)
    s = lo / lo.sum() - hi / hi.sum()
    order = np.argsort(s, kind="stable")[::-1]
    spread = s.max() - s.min()
    top, sure = int(order[0]), min(1.0, (s[order[0]] - s[order[1]]) / spread / 0.25)
    tied = [int(i) for i in order if i != top and (s[top] - s[i]) / spread <= 0.25]
    if tied:
        top = near if near in tied else top
    elif near is not None and near != top:
        sure = min(sure, 0.5)
    return "ok" if sure >= 1 else "ambiguous", top, at, contrast, sure, s


def series(seed, period, first=0, accent=2.0, hats=True, n=2400):
    """A low hit on every beat, stronger on each fourth from ``first``; hats on the beats between."""
    rng = np.random.default_rng(seed)
    low, bright = rng.random(n) * 0.01, rng.random(n) * 1e-6
    for k in range(int(n * HOP / period)):
        i = round((0.2 + k * period) / HOP)
        if i + 8 < n:
            low[i : i + 8] += (accent if k % 4 == first else 1.0) * np.exp(-np.arange(8) / 2)
            if hats and k % 4 != first:
                bright[i : i + 4] += 0.5 + 0.05 * rng.random()
    return low, bright


def test_against_plain_loops(spark):
    data = {"plain": (0.5, series(1, 0.5)), "shifted": (0.47, series(2, 0.47, first=2)), "flat": (0.5, series(3, 0.5, accent=1.0, hats=False)), "weak": (0.6, series(4, 0.6, accent=1.05)), "noise": (0.4, tuple(np.random.default_rng(5).random((2, 1500))))}
    rows = [(t, i, float(a), float(b)) for t, (_, (low, bright)) in data.items() for i, (a, b) in enumerate(zip(low, bright))]
    rows += [("still", i, 0.0, 0.0) for i in range(50)]
    env = spark.createDataFrame(rows, "track string, frame long, low double, bright double")
    meta = spark.createDataFrame([(t, p) for t, (p, _) in data.items()] + [("still", 0.5), ("none", None)], "track string, period_seconds double")
    got = {r["track"]: r for r in downbeat.find_downbeat(env, meta, ["track"], HOP).collect()}
    for t, (period, (low, bright)) in data.items():
        status, slot, at, contrast, sure, scores = brute(low, bright, period)
        r = got[t]
        assert (r["status"], r["bar_phase"]) == (status, slot), t
        assert abs(r["beat_offset"] - at * HOP) < 1e-9 and abs(r["beat_confidence"] - contrast) < 1e-9
        assert abs(r["phase_confidence"] - sure) < 1e-9 and np.allclose(r["candidate_scores"], scores)
        assert abs(r["offset_seconds"] - (at * HOP + slot * period)) < 1e-9
    assert got["shifted"]["bar_phase"] == 2 and got["plain"]["status"] == "ok"
    assert got["still"]["status"] == got["none"]["status"] == "unavailable" and got["none"]["offset_seconds"] is None
