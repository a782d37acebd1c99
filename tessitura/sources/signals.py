"""Test signals by name, each the same every time: tones, noises, drum patterns and bass lines at 120 beats a minute.

What they must come out as is known, so they test the way from samples to notes and hits.
"""

from __future__ import annotations

import numpy as np

from tessitura.functions.scalars import SAMPLE_RATE
from tessitura.sources import audio

BPM, FIRST, STEP = 120.0, 0.25, 0.125
#: Pitches of the bass lines in MIDI numbers, a beat each.
LINE = [33, 33, 36, 40] * 4


def hertz(midi: float) -> float:
    return 440.0 * 2 ** ((midi - 69) / 12)


def sine(hz: float = 440.0, seconds: float = 8.0, level: float = 0.5) -> np.ndarray:
    return level * np.sin(2 * np.pi * hz * np.arange(int(seconds * SAMPLE_RATE)) / SAMPLE_RATE)


def white(seconds: float = 8.0, seed: int = 0, level: float = 0.2) -> np.ndarray:
    return level * np.random.default_rng(seed).standard_normal(int(seconds * SAMPLE_RATE))


def shaped(seconds: float, seed: int, response, level: float) -> np.ndarray:
    """Noise whose spectrum is ``response(frequencies)`` times white, scaled to a mean square of ``level`` squared."""
    n = int(seconds * SAMPLE_RATE)
    spectrum = np.fft.rfft(np.random.default_rng(seed).standard_normal(n)) * response(np.fft.rfftfreq(n, 1 / SAMPLE_RATE))
    x = np.fft.irfft(spectrum, n)
    return level * x / np.sqrt((x**2).mean())


def pink(seconds: float = 8.0, seed: int = 1) -> np.ndarray:
    """Two channels of power that falls as the frequency rises."""
    fall = lambda f: 1 / np.sqrt(np.maximum(f, 20.0))
    return np.stack([shaped(seconds, seed + c, fall, 0.1) for c in (0, 100)], axis=1)


def open_hat(n: int = 24000, seed: int = 3) -> np.ndarray:
    x = np.random.default_rng(seed).standard_normal(n)
    return np.diff(np.diff(x, prepend=0), prepend=0) * np.exp(-np.arange(n) / SAMPLE_RATE * 9) * 0.2


def pattern(steps: dict, bars: int = 4) -> np.ndarray:
    """Shots at steps of sixteen to a bar."""
    hits = [(FIRST + (b * 16 + s) * STEP, shot) for b in range(bars) for shot, on in steps.values() for s in on]
    return audio.place(sorted(hits, key=lambda h: h[0]), FIRST + bars * 16 * STEP + 0.75)


def bass(pitches: list[int], partials: list[float], glide: float = 0.0, seconds: float = 0.42) -> np.ndarray:
    """A note a beat; with ``glide`` seconds each slides to the next and sounds up to it."""
    out = np.zeros(int((FIRST + len(pitches) * 0.5 + 0.25) * SAMPLE_RATE))
    length = int((0.5 if glide else seconds) * SAMPLE_RATE)
    hz = np.repeat([hertz(m) for m in pitches], length).astype(float)
    if glide:
        width = int(glide * SAMPLE_RATE)
        for k in range(1, len(pitches)):
            a, b = hertz(pitches[k - 1]), hertz(pitches[k])
            hz[k * length - width : k * length] = a * (b / a) ** (np.arange(width) / width)
    turn = 2 * np.pi * np.cumsum(hz) / SAMPLE_RATE
    tone = sum(p * np.sin((i + 1) * turn) for i, p in enumerate(partials)) / sum(partials)
    for k in range(len(pitches)):
        part = tone[k * length : (k + 1) * length].copy()
        if not glide:
            part *= np.minimum(1, np.minimum(np.arange(length), length - 1 - np.arange(length)) / 220)
        at = int((FIRST + k * 0.5) * SAMPLE_RATE)
        out[at : at + length] += 0.5 * part
    return out


#: Signals by name.
SIGNALS = {
    "sine_a440": sine,
    "white_noise": white,
    "pink_noise": pink,
    "silence": lambda: np.zeros(4 * SAMPLE_RATE),
    "drum_pattern": lambda: pattern({"kick": (audio.kick(), (0, 8)), "snare": (audio.snare(), (4, 12)), "hat": (audio.hat(), range(0, 16, 2))}),
    "kick_only": lambda: pattern({"kick": (audio.kick(), (0, 4, 8, 12))}),
    "open_hats": lambda: pattern({"kick": (audio.kick(), (0, 8)), "snare": (audio.snare(), (4, 12)), "hat": (open_hat(), range(0, 16, 2))}),
    "ambiguous": lambda: pattern({"kick": (audio.kick(), (0, 8)), "click": (audio.click(), (2, 6, 10, 14))}),
    "bass_line": lambda: bass(LINE, [1.0, 0.5, 0.25]),
    "octave_trap": lambda: bass(LINE, [0.15, 1.0, 0.4]),
    "glide": lambda: bass([33, 40] * 8, [1.0, 0.5, 0.25], glide=0.04),
    "unvoiced": lambda: shaped(8.5, 21, lambda f: ((f >= 20) & (f <= 200)).astype(float), 0.1),
}
