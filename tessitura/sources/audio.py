"""Sound in: WAV reading, synthesis, resampling, and one pass of frames over chunks.

A chunk row holds its own samples and a halo of half a window on either side, so frames are
computed for each chunk alone and a recording never has to fit in one task.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.functions.scalars import HOP, N_FFT, SAMPLE_RATE

#: Detection bands in Hz (the last closed above), the tempo band, bright band.
BANDS = {"kick": (20, 150), "body": (150, 500), "noise": (1000, 6000), "air": (6000, 16000), "tempo": (20, 110)}
CHUNK_FRAMES = 512
WAV_ROW = "path string, sample_rate int, channels int, samples array<float>, error string"


def decode_wav(raw: bytes) -> tuple[int, np.ndarray]:
    """(sample rate, samples by channel) of PCM 8, 16, 24, 32 bit or float 32, 64 bit."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, data = 12, None, None
    while at + 8 <= len(raw):
        tag, size = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
        body = raw[at + 8 : at + 8 + size]
        if tag == b"fmt ":
            kind = struct.unpack("<HHIIHH", body[:16])
            if kind[0] == 0xFFFE:
                kind = (struct.unpack("<H", body[24:26])[0], *kind[1:])
        elif tag == b"data":
            data = body
        at += 8 + size + size % 2
    if kind is None or data is None:
        raise ValueError("no format or data in the WAV file")
    code, channels, rate, _, _, bits = kind
    return rate, decode_samples(data, code, channels, bits)


#: (format code, bits) of PCM and float samples.
ENCODINGS = [(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)]


def decode_samples(data: bytes, code: int, channels: int, bits: int) -> np.ndarray:
    """Samples by channel; a torn last frame is left out."""
    data = data[: len(data) // (channels * bits // 8) * (channels * bits // 8)]
    if (code, bits) not in ENCODINGS:
        raise ValueError(f"format {code} of {bits} bits isn't supported")
    if code == 3:
        x = np.frombuffer(data, "<f4" if bits == 32 else "<f8").astype(np.float32)
    elif bits == 24:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x = ((v ^ 0x800000) - 0x800000).astype(np.float32) / (1 << 23)
    elif bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    else:
        x = np.frombuffer(data, f"<i{bits // 8}").astype(np.float32) / float(1 << (bits - 1))
    return x.reshape(-1, channels)


def to_mono(x: np.ndarray) -> np.ndarray:
    return x if x.ndim == 1 else x.mean(axis=1)


def ensure_stereo(x: np.ndarray) -> np.ndarray:
    return np.column_stack((x, x)) if x.ndim == 1 or x.shape[1] == 1 else x[:, :2]


TAPS = 32


def resample_reach(rate: int, to: int = SAMPLE_RATE) -> int:
    """Samples on either side that one interpolated sample looks at."""
    return int(np.ceil(TAPS / min(1.0, to / rate) / 2))


def resample(x: np.ndarray, rate: int, to: int = SAMPLE_RATE) -> np.ndarray:
    """Windowed-sinc interpolation, cut off below the lower Nyquist frequency."""
    if rate == to or not len(x):
        return x.astype(np.float32)
    return resample_part(x, rate, 0, int(round(len(x) * to / rate)), 0, to)


def resample_part(x: np.ndarray, rate: int, start: int, stop: int, first: int, to: int = SAMPLE_RATE) -> np.ndarray:
    """Output samples [start, stop) of a recording of which ``x`` holds the input samples from ``first`` on, silence beyond."""
    cut, half = min(1.0, to / rate), resample_reach(rate, to)
    t = np.arange(start, stop) * (rate / to)
    left = np.floor(t).astype(np.int64)
    out = np.zeros(len(t))
    for k in range(-half + 1, half + 1):
        i = left + k
        d = t - i
        w = np.sinc(d * cut) * cut * np.where(np.abs(d) < half, 0.5 + 0.5 * np.cos(np.pi * d / half), 0)
        out += np.where((i >= first) & (i < first + len(x)), x[np.clip(i - first, 0, len(x) - 1)], 0) * w
    return out.astype(np.float32)


def resample_linear(x: np.ndarray, rate: int, to: int = SAMPLE_RATE) -> np.ndarray:
    n = int(round(len(x) * to / rate))
    return np.interp(np.arange(n) * (rate / to), np.arange(len(x)), x).astype(np.float32)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """WAV_ROW of every file under ``path``: mono at 44.1 kHz, or the error that kept it from being read."""

    def run(batches):
        for batch in batches:
            rows = []
            for p, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rate, x = decode_wav(raw)
                    rows.append((p, SAMPLE_RATE, x.shape[1], resample(to_mono(x), rate), None))
                except (ValueError, struct.error) as e:
                    rows.append((p, None, None, None, str(e)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.float32())), pa.array(cols[4], pa.string())], names=[c.split()[0] for c in WAV_ROW.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, WAV_ROW)


#: What a chunk row may carry of its neighbours: samples before and after its own.
BEFORE, AFTER = 8192, 1024
CHUNK = "track string, source string, chunk long, samples array<float>, total long"


def chunk_span(chunk: int, total: int, frames: int = CHUNK_FRAMES) -> tuple[int, int]:
    """The samples [start, stop) that a chunk's frames cover, half a window beyond the first and last."""
    n = 1 + total // HOP
    a, b = chunk * frames, min(n, (chunk + 1) * frames)
    return a * HOP - N_FFT // 2, (b - 1) * HOP + N_FFT // 2


def chunks(x: np.ndarray, frames: int = CHUNK_FRAMES):
    """(chunk, samples with halo) of a recording; beyond its ends there is silence."""
    padded = np.r_[np.zeros(N_FFT // 2, np.float32), x, np.zeros(N_FFT, np.float32)]
    for c in range(-(-(1 + len(x) // HOP) // frames)):
        start, stop = chunk_span(c, len(x), frames)
        yield c, padded[start + N_FFT // 2 : stop + N_FFT // 2]


def with_neighbours(audio: DataFrame) -> DataFrame:
    """Chunk rows with ``before`` and ``after``, what their neighbours hold next to them; null at the ends.

    A source that reads files carries them already; else only the edges of each chunk meet the next by key.
    """
    if {"before", "after"} <= set(audio.columns):
        return audio
    shared = N_FFT - HOP  # samples that two neighbours both hold
    n = F.size("samples")
    # a whole recording's last chunk has no follower and a first one no edge before it
    first = F.greatest(F.lit(1), n - shared - BEFORE + 1)
    left = audio.select("track", "source", (F.col("chunk") + 1).alias("chunk"), F.slice("samples", first, F.greatest(F.lit(0), F.least(F.lit(BEFORE), n - shared))).alias("before"))
    right = audio.select("track", "source", (F.col("chunk") - 1).alias("chunk"), F.slice("samples", shared + 1, AFTER).alias("after"))
    keys = ["track", "source", "chunk"]
    return audio.join(left, keys, "left").join(right, keys, "left")


def power_frames(samples: np.ndarray) -> np.ndarray:
    """Power spectra of the frames of one chunk: periodic Hann window of 2048, hop 512."""
    x = np.nan_to_num(samples.astype(float), nan=0.0, posinf=0.0, neginf=0.0)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(N_FFT) / N_FFT)
    frames = np.lib.stride_tricks.sliding_window_view(x, N_FFT)[::HOP]
    return np.abs(np.fft.rfft(frames * window, axis=1)) ** 2


def band_energy(power: np.ndarray) -> dict[str, np.ndarray]:
    freq = np.arange(N_FFT // 2 + 1) * SAMPLE_RATE / N_FFT
    return {b: power[:, (freq >= lo) & ((freq <= hi) if b == "air" else (freq < hi))].sum(1) for b, (lo, hi) in BANDS.items()}


#: The shared bands of the spectral descriptors in Hz (the last closed above), and where brightness begins.
SHARED = {"e_low": (20, 250), "e_low_mid": (250, 2000), "e_high_mid": (2000, 6000), "e_high": (6000, 20000)}
BRIGHT_HZ, ROLLOFF, CHROMA_HZ = 1500, 0.85, (55, 5000)
SPECTRAL = ["power", *SHARED, "e_bright", "e_moment", "centroid", "rolloff"]
FRAME = "track string, source string, frame long, " + ", ".join(f"{b} double" for b in [*BANDS, "rms", *SPECTRAL]) + ", chroma array<double>"
FREQ = np.arange(N_FFT // 2 + 1) * SAMPLE_RATE / N_FFT


def pitch_classes(power: np.ndarray) -> np.ndarray:
    """Power by pitch class from c on, the greatest of each frame 1; zeros for silence."""
    inside = np.flatnonzero((FREQ >= CHROMA_HZ[0]) & (FREQ <= CHROMA_HZ[1]))
    pc = np.rint(69 + 12 * np.log2(FREQ[inside] / 440)).astype(int) % 12
    fold = np.zeros((len(inside), 12))
    fold[np.arange(len(inside)), pc] = 1
    out = power[:, inside] @ fold
    top = out.max(1, keepdims=True)
    return np.divide(out, top, out=np.zeros_like(out), where=top > 0)


def spectral(power: np.ndarray) -> dict[str, np.ndarray]:
    """Sums of each frame over the shared bands, and centroid and rolloff of its magnitudes (NaN for silence)."""
    out = {"power": power.sum(1)}
    for b, (lo, hi) in SHARED.items():
        out[b] = power[:, (FREQ >= lo) & ((FREQ <= hi) if b == "e_high" else (FREQ < hi))].sum(1)
    heard = (FREQ >= 20) & (FREQ <= 20000)
    out["e_bright"] = power[:, heard & (FREQ >= BRIGHT_HZ)].sum(1)
    out["e_moment"] = power[:, heard] @ FREQ[heard]
    magnitude = np.sqrt(power)
    total = magnitude.sum(1)
    some = total > 0
    out["centroid"] = np.divide(magnitude @ FREQ, total, out=np.full(len(power), np.nan), where=some)
    reached = np.cumsum(magnitude, axis=1) >= ROLLOFF * total[:, None]
    out["rolloff"] = np.where(some, FREQ[reached.argmax(1)], np.nan)
    return out


def _samples(batch, name: str = "samples"):
    """(row, samples) of a batch of chunks, without a Python object for each sample; null has none."""
    column = batch.column(name)
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for i in range(batch.num_rows):
        yield i, np.nan_to_num(flat[ends[i] : ends[i + 1]].astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)


def _edges(batch):
    """(row, samples, BEFORE samples before them, AFTER samples after), silence where there are none."""
    for (i, x), (_, a), (_, b) in zip(_samples(batch), _samples(batch, "before"), _samples(batch, "after"), strict=True):
        yield i, x, np.r_[np.zeros(BEFORE - len(a)), a], np.r_[b, np.zeros(AFTER - len(b))]


def frame_bands(audio: DataFrame) -> DataFrame:
    """FRAME rows from chunk rows (track, source, chunk, samples): the only pass over samples."""

    def run(batches):
        for batch in batches:
            tracks, sources, numbers = (batch.column(c).to_pylist() for c in ("track", "source", "chunk"))
            for i, x in _samples(batch):
                power = power_frames(x)
                e = band_energy(power) | {"rms": np.sqrt((np.lib.stride_tricks.sliding_window_view(x, N_FFT)[::HOP] ** 2).mean(1))} | spectral(power)
                n = len(power)
                chroma = pa.ListArray.from_arrays(pa.array(np.arange(0, 12 * n + 1, 12), pa.int32()), pa.array(pitch_classes(power).ravel()))
                cols = [pa.array([tracks[i]] * n), pa.array([sources[i]] * n), pa.array(numbers[i] * CHUNK_FRAMES + np.arange(n), pa.int64())]
                cols += [pa.array(e[b], from_pandas=True) for b in [*BANDS, "rms", *SPECTRAL]] + [chroma]
                yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in FRAME.split(", ")])

    return audio.mapInArrow(run, FRAME)


def wav_chunks(wavs: DataFrame) -> DataFrame:
    """Chunk rows (track, source, chunk, samples) of decoded files <track>/<source>.wav; those with an error have none."""

    def run(batches):
        for batch in batches:
            paths = batch.column("path").to_pylist()
            for i, x in _samples(batch):
                *_, track, name = ["", *paths[i].split("/")]
                for c, part in chunks(x.astype(np.float32)):
                    yield chunk_row(track, name.rsplit(".", 1)[0], c, part, len(x))

    return wavs.filter("error is null").select("path", "samples").mapInArrow(run, CHUNK)


def chunk_row(track: str, source: str, chunk: int, samples: np.ndarray, total: int) -> pa.RecordBatch:
    cols = [pa.array([track]), pa.array([source]), pa.array([chunk], pa.int64()), pa.array([samples.astype(np.float32)], pa.list_(pa.float32())), pa.array([total], pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=["track", "source", "chunk", "samples", "total"])


#: Fixed value: the peaks of a frame that count.
MOST_PEAKS = 5
PEAK_ROW = "track string, source string, frame long, hz double, magnitude double"


def spectral_peaks(power: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frame, hz, magnitude) of the strongest local maxima of each frame's magnitudes, each at the top of a parabola through the logarithms of three bins."""
    m = np.sqrt(power)
    inner = m[:, 1:-1]
    top = np.where((inner > m[:, :-2]) & (inner >= m[:, 2:]), inner, -1.0)
    keep = np.argsort(-top, axis=1, kind="stable")[:, :MOST_PEAKS]
    rows, cols = np.nonzero(np.take_along_axis(top, keep, 1) > 0)
    k = keep[rows, cols] + 1
    a, b, c = (np.log(np.maximum(m[rows, i], 1e-30)) for i in (k - 1, k, k + 1))
    bend = a - 2 * b + c
    shift = np.divide(0.5 * (a - c), bend, out=np.zeros_like(bend), where=bend != 0)
    return rows, (k + shift) * SAMPLE_RATE / N_FFT, np.exp(b - 0.25 * (a - c) * shift)


def frame_peaks(audio: DataFrame) -> DataFrame:
    """PEAK_ROW rows from chunk rows: the spectral peaks of each frame, for ``tonal.peak_classes``."""

    def run(batches):
        for batch in batches:
            tracks, sources, numbers = (batch.column(c).to_pylist() for c in ("track", "source", "chunk"))
            for i, x in _samples(batch):
                rows, hz, magnitude = spectral_peaks(power_frames(x))
                cols = [pa.array([tracks[i]] * len(rows)), pa.array([sources[i]] * len(rows)), pa.array(numbers[i] * CHUNK_FRAMES + rows, pa.int64()), pa.array(hz), pa.array(magnitude)]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in PEAK_ROW.split(", ")])

    return audio.select("track", "source", "chunk", "samples").mapInArrow(run, PEAK_ROW)


def hit_spectra(audio: DataFrame, hits: DataFrame) -> DataFrame:
    """(track, source, frame, power) of hits (track, source, frame, end): the power of each bin, summed over the frames [frame, end).

    A hit meets the chunks that its frames lie in, one or two as a rule, by key; each gives a part and the parts are added.
    """
    h = hits.select("track", "source", "frame", "end", F.explode(F.sequence(F.floor(F.col("frame") / CHUNK_FRAMES), F.floor((F.col("end") - 1) / CHUNK_FRAMES))).alias("chunk"))
    spans = h.groupBy("track", "source", "chunk").agg(F.collect_list("frame").alias("starts"), F.collect_list("end").alias("ends"))
    rows = audio.select("track", "source", "chunk", "samples").join(spans, ["track", "source", "chunk"])

    def run(batches):
        for batch in batches:
            tracks, sources, numbers, starts, ends = (batch.column(c).to_pylist() for c in ("track", "source", "chunk", "starts", "ends"))
            for i, x in _samples(batch):
                power, first = power_frames(x), numbers[i] * CHUNK_FRAMES
                parts = [power[max(0, a - first) : max(0, b - first)].sum(0) for a, b in zip(starts[i], ends[i], strict=True)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([tracks[i]] * n), pa.array([sources[i]] * n), pa.array(starts[i], pa.int64()), pa.array(parts, pa.list_(pa.float64()))], names=["track", "source", "frame", "power"])

    parts = rows.mapInArrow(run, "track string, source string, frame long, power array<double>")
    both = parts.groupBy("track", "source", "frame").agg(F.collect_list("power").alias("_p"))
    return both.select("track", "source", "frame", F.aggregate(F.slice(F.col("_p"), F.lit(2), F.size("_p")), F.col("_p")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("power"))


PITCH_WINDOW, PITCH_HZ, PITCH_MIN = 4096, (30.0, 400.0), 0.7
F0 = "track string, source string, frame long, f0_hz double, voiced boolean, voiced_prob double, error string"


def pitch(audio: DataFrame, method: str = "yin") -> DataFrame:
    """F0 rows from chunk rows, the same for any cutting into chunks; voiced where the confidence is 0.7 or more and the frequency in range.

    ``method`` is a name of ESTIMATORS: yin compares the frame with itself, yinfft goes through its power spectrum. A column
    ``method`` names it for each row. A chunk whose estimator fails has one row without a frame, with the ``error``; the others stay as they are.
    """
    if method not in ESTIMATORS:
        raise ValueError(f"no pitch estimator {method!r}; there are {', '.join(ESTIMATORS)}")

    def run(batches):
        for batch in batches:
            tracks, sources, numbers, methods = (batch.column(c).to_pylist() for c in ("track", "source", "chunk", "method"))
            for i, x, before, after in _edges(batch):
                n, more = 1 + (len(x) - N_FFT) // HOP, PITCH_WINDOW // 2 - N_FFT // 2
                try:
                    f0, confidence = by_blocks(np.r_[before[len(before) - more :], x, after[:more]], n, ESTIMATORS[methods[i]])
                    voiced = (confidence >= PITCH_MIN) & (f0 >= PITCH_HZ[0]) & (f0 <= PITCH_HZ[1])
                    cols = [pa.array(numbers[i] * CHUNK_FRAMES + np.arange(n), pa.int64()), pa.array(f0, from_pandas=True), pa.array(voiced), pa.array(confidence), pa.array([None] * n, pa.string())]
                except Exception as e:  # noqa: BLE001 - whatever is wrong with one recording stays with it
                    cols, n = [pa.array([None], k) for k in (pa.int64(), pa.float64(), pa.bool_(), pa.float64())] + [pa.array([f"{type(e).__name__}: {e}"])], 1
                yield pa.RecordBatch.from_arrays([pa.array([tracks[i]] * n), pa.array([sources[i]] * n), *cols], names=[c.split()[0] for c in F0.split(", ")])

    named = audio if "method" in audio.columns else audio.withColumn("method", F.lit(method))
    return with_neighbours(named).select("track", "source", "chunk", "samples", "before", "after", "method").mapInArrow(run, F0)


#: Frames that are estimated at once: some tens of MB.
FRAMES_AT_ONCE = 128


def by_blocks(x: np.ndarray, n: int, estimate) -> tuple[np.ndarray, np.ndarray]:
    """(f0, confidence) of the n frames of PITCH_WINDOW samples that begin every HOP of ``x``; silent ones have no f0."""
    x = np.r_[x, np.zeros(max(0, (n - 1) * HOP + PITCH_WINDOW - len(x)))]
    frames = np.lib.stride_tricks.sliding_window_view(x, PITCH_WINDOW)[::HOP][:n]
    f0, confidence = np.full(n, np.nan), np.zeros(n)
    for at in range(0, n, FRAMES_AT_ONCE):
        block = frames[at : at + FRAMES_AT_ONCE]
        live = np.flatnonzero(block.any(axis=1))
        if len(live):
            f0[at + live], confidence[at + live] = estimate(block[live])
    return f0, confidence


def _lags(window: int) -> tuple[int, int]:
    return int(SAMPLE_RATE / PITCH_HZ[1]), min(int(SAMPLE_RATE / PITCH_HZ[0]), window // 2 - 1)


def _dip(d: np.ndarray, short: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, place, normalised) of differences by lag from 1 on: the foot of the first dip under the threshold, else the least."""
    lags = np.arange(1, d.shape[1] + 1)
    norm = d * lags / np.maximum(np.cumsum(d, axis=1), 1e-12)
    zone = norm[:, short - 1 :]
    under = zone < threshold
    k = np.where(under.any(axis=1), under.argmax(axis=1), zone.argmin(axis=1))
    # downhill from there: up to the first place whose successor isn't lower
    stops = np.c_[zone[:, 1:] >= zone[:, :-1], np.ones(len(zone), bool)] & (np.arange(zone.shape[1]) >= k[:, None])
    return np.arange(len(zone)), stops.argmax(axis=1), zone


def yin_frames(frames: np.ndarray, threshold: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """F0 and confidence of each row by the cumulative mean normalised difference, all rows in one transform."""
    window = frames.shape[1]
    short, long = _lags(window)
    half, size = window // 2, 1 << (2 * window - 1).bit_length()
    acf = np.fft.irfft(np.conj(np.fft.rfft(frames[:, :half], size)) * np.fft.rfft(frames, size), size)[:, : long + 1]
    sq = np.c_[np.zeros(len(frames)), np.cumsum(frames**2, axis=1)]
    d = sq[:, half, None] + sq[:, half + np.arange(long + 1)] - sq[:, np.arange(long + 1)] - 2 * acf
    rows, k, zone = _dip(d[:, 1:], short, threshold)
    return SAMPLE_RATE / (k + short), np.maximum(0.0, 1 - zone[rows, k])


def yinfft_frames(frames: np.ndarray, threshold: float = 0.85) -> tuple[np.ndarray, np.ndarray]:
    """The same search on the difference that the power spectrum of the Hann-windowed row gives, its foot by a parabola.

    Power back-transformed is the correlation of the windowed row with itself, so the difference at a lag is twice what it falls short of
    that at 0. The threshold is high, as the normalised difference of a windowed row is; the least of all counts.
    """
    window = frames.shape[1]
    short, long = _lags(window)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    acf = np.fft.irfft(np.abs(np.fft.rfft(frames * hann, 2 * window)) ** 2, 2 * window)[:, : long + 2]
    bias = np.fft.irfft(np.abs(np.fft.rfft(hann, 2 * window)) ** 2, 2 * window)[: long + 2]
    acf = acf / np.maximum(bias / bias[0], 1e-6)  # what the window alone takes away at each lag
    d = np.maximum(0.0, 2 * (acf[:, :1] - acf))
    rows, k, zone = _dip(d[:, 1 : long + 1], short, threshold * 0.2)
    inner = np.clip(k, 1, zone.shape[1] - 2)
    a, b, c = zone[rows, inner - 1], zone[rows, inner], zone[rows, inner + 1]
    bend = a - 2 * b + c
    with np.errstate(divide="ignore", invalid="ignore"):
        shift = np.where((inner == k) & (bend > 0), 0.5 * (a - c) / bend, 0.0)
    return SAMPLE_RATE / (k + short + np.clip(shift, -0.5, 0.5)), np.clip(1 - zone[rows, k], 0.0, 1.0)


#: Pitch estimators by name: from rows of PITCH_WINDOW samples, none silent, to (f0, confidence).
ESTIMATORS = {"yin": yin_frames, "yinfft": yinfft_frames}


def click(n: int = 400) -> np.ndarray:
    t = np.arange(n) / SAMPLE_RATE
    return np.sin(2 * np.pi * 1500 * t) * np.exp(-t * 600)


def kick(n: int = 8000) -> np.ndarray:
    t = np.arange(n) / SAMPLE_RATE
    return np.sin(2 * np.pi * (50 * t + 0.8 * (1 - np.exp(-t * 40)))) * np.exp(-t * 18)


def hat(n: int = 3000, seed: int = 3) -> np.ndarray:
    x = np.random.default_rng(seed).standard_normal(n)
    return np.diff(np.diff(x, prepend=0), prepend=0) * np.exp(-np.arange(n) / SAMPLE_RATE * 120) * 0.2


def snare(n: int = 6000, seed: int = 4) -> np.ndarray:
    t = np.arange(n) / SAMPLE_RATE
    return (np.sin(2 * np.pi * 220 * t) + 0.3 * np.random.default_rng(seed).standard_normal(n)) * np.exp(-t * 30)


def place(events: list[tuple[float, np.ndarray]], seconds: float) -> np.ndarray:
    """Adds shots at times; one whose tail would overrun is left out."""
    out = np.zeros(int(seconds * SAMPLE_RATE), np.float32)
    for at, shot in events:
        i = int(round(at * SAMPLE_RATE))
        if i + len(shot) <= len(out):
            out[i : i + len(shot)] += shot
    return out


def click_train(bpm: float, seconds: float = 60.0, first: float = 0.25) -> np.ndarray:
    return place([(first + i * 60 / bpm, click()) for i in range(int((seconds - first) * bpm / 60))], seconds)


def drum_pattern(bpm: float = 120.0, bars: int = 4, first: float = 0.25) -> np.ndarray:
    """Sixteen steps: kick on 0 and 8, snare on 4 and 12, hat on the even ones."""
    step = 60 / bpm / 4
    hits = [(first + (b * 16 + s) * step, shot()) for b in range(bars) for s in range(16) for shot, on in ((kick, (0, 8)), (snare, (4, 12)), (hat, range(0, 16, 2))) if s in on]
    return place(hits, first + bars * 16 * step + 0.5)


def as_chunks(spark: SparkSession, recordings: dict[tuple[str, str], tuple]) -> DataFrame:
    """Chunk rows of synthesised recordings: (track, source) to (function name, arguments), made on the executors."""
    specs = spark.createDataFrame([(t, s, f, [float(a) for a in args]) for (t, s), (f, *args) in recordings.items()], "track string, source string, f string, args array<double>")
    makers = {"click_train": click_train, "drum_pattern": lambda bpm, bars: drum_pattern(bpm, int(bars)), "noise": lambda seed, seconds: np.random.default_rng(int(seed)).standard_normal(int(seconds * SAMPLE_RATE)).astype(np.float32) * 0.2}

    def run(batches):
        for batch in batches:
            for t, s, f, args in zip(*(batch.column(n).to_pylist() for n in ("track", "source", "f", "args")), strict=True):
                whole = makers[f](*args)
                for c, x in chunks(whole):
                    yield chunk_row(t, s, c, x, len(whole))

    return specs.mapInArrow(run, CHUNK)


def missing(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and not there yet: the resume rule."""
    return wanted.join(present.select(*keys).distinct(), keys, "left_anti")


def yin(samples: np.ndarray, method: str = "yin") -> tuple[np.ndarray, np.ndarray]:
    """(f0, confidence) of each frame of a whole recording."""
    return by_blocks(np.r_[np.zeros(PITCH_WINDOW // 2), np.asarray(samples, float)], 1 + len(samples) // HOP, ESTIMATORS[method])


#: Fixed values of the loudness measure: the two filters (gain dB, quality, corner Hz), blocks and gates.
SHELF, HIGH_PASS = (3.999843853973347, 0.7071752369554196, 1681.974450955533), (0.0, 0.5003270373238773, 38.13547087602444)
CELL, CELLS, ABSOLUTE_GATE, RELATIVE_GATE, OFFSET_DB = 4410, 4, -70.0, 10.0, -0.691


@lru_cache(maxsize=1)
def weighting() -> np.ndarray:
    """Impulse response of the two loudness filters over BEFORE samples; what comes later is below 1e-16 of it."""
    y = np.zeros(BEFORE)
    y[0] = 1.0
    for gain, q, fc in (SHELF, HIGH_PASS):
        k = np.tan(np.pi * fc / SAMPLE_RATE)
        if gain:
            v = 10 ** (gain / 20)
            vb = v**0.4996667741545416
            num = (v + vb * k / q + k * k, 2 * (k * k - v), v - vb * k / q + k * k)
        else:
            n = 1 + k / q + k * k
            num = (n, -2 * n, n)
        den = (1 + k / q + k * k, 2 * (k * k - 1), 1 - k / q + k * k)
        x, y = y, np.zeros(BEFORE)
        for i in range(BEFORE):
            past = sum(num[j] * x[i - j] for j in range(min(3, i + 1))) - sum(den[j] * y[i - j] for j in range(1, min(3, i + 1)))
            y[i] = past / den[0]
    return y


def weighted(x: np.ndarray) -> np.ndarray:
    """The samples after the loudness filters, which start from silence."""
    size = 1 << max(1, len(x) + BEFORE - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(weighting(), size), size)[: len(x)]


@lru_cache(maxsize=4)
def _response(size: int) -> np.ndarray:
    return np.fft.rfft(weighting(), size)


def weighted_after(x: np.ndarray) -> np.ndarray:
    """The samples after the first BEFORE ones, after the loudness filters: the transform is as long as ``x``, as its wrap only touches those."""
    size = -(-len(x) // BEFORE) * BEFORE
    return np.fft.irfft(np.fft.rfft(x, size) * _response(size), size)[BEFORE : len(x)]


def loudness(samples: np.ndarray) -> float | None:
    """Integrated loudness in LUFS of a whole recording in memory; null under 0.4 s."""
    y = weighted(np.asarray(samples, float)) ** 2
    cells = np.add.reduceat(y, np.arange(0, len(y), CELL)) if len(y) else y
    cells = cells[: len(y) // CELL]
    p = np.array([cells[i : i + CELLS].sum() / (CELL * CELLS) for i in range(len(cells) - CELLS + 1)])
    level = lambda m: OFFSET_DB + 10 * np.log10(np.maximum(m, 1e-30))
    p = p[level(p) > ABSOLUTE_GATE] if len(p) else p
    if not len(p):
        return None
    p = p[level(p) > level(p.mean()) - RELATIVE_GATE]
    return float(level(p.mean())) if len(p) else None


CELL_ROW = "track string, source string, cell bigint, weighted double, squared double, peak double, n bigint"


def cells(audio: DataFrame) -> DataFrame:
    """Sums over cells of 100 ms: filtered and plain squares, the greatest sample and how many there are.

    A chunk is filtered with the BEFORE samples before it, beyond which the filters remember nothing that a double can hold.
    A cell that two chunks share comes in two rows.
    """
    a = with_neighbours(audio)
    a = a if "total" in a.columns else a.withColumn("total", F.lit(None).cast("long"))

    def run(batches):
        for batch in batches:
            tracks, sources, numbers, totals = (batch.column(c).to_pylist() for c in ("track", "source", "chunk", "total"))
            for i, x, before, _ in _edges(batch):
                start = numbers[i] * CHUNK_FRAMES * HOP
                hops = (1 + (len(x) - N_FFT) // HOP) * HOP
                own = hops if totals[i] is None else min(CHUNK_FRAMES * HOP, totals[i] - start)
                if own <= 0:
                    continue
                whole = np.r_[before, x[: N_FFT // 2 + own]]
                y, x = weighted_after(whole)[-own:] ** 2, whole[-own:]
                first = start // CELL
                at = np.maximum(0, np.arange(first, (start + own - 1) // CELL + 1) * CELL - start)
                n = np.diff(np.r_[at, own])
                cols = [pa.array([tracks[i]] * len(at)), pa.array([sources[i]] * len(at)), pa.array(first + np.arange(len(at)), pa.int64()), pa.array(np.add.reduceat(y, at)), pa.array(np.add.reduceat(x * x, at)), pa.array(np.maximum.reduceat(np.abs(x), at)), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in CELL_ROW.split(", ")])

    return a.select("track", "source", "chunk", "samples", "before", "after", "total").mapInArrow(run, CELL_ROW)


def gated(cells_: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lufs) from cells (keys, cell, weighted, n): blocks of four whole cells, the absolute gate, then the relative one."""
    four = Window.partitionBy(*keys).orderBy("cell").rangeBetween(0, CELLS - 1)
    level = lambda p: F.lit(OFFSET_DB) + F.lit(10.0) * F.log10(F.greatest(p, F.lit(1e-30)))
    b = cells_.withColumn("_p", F.sum("weighted").over(four) / float(CELL * CELLS)).withColumn("_n", F.sum("n").over(four))
    b = b.filter(F.col("_n") == CELL * CELLS).filter(level(F.col("_p")) > ABSOLUTE_GATE).select(*keys, "_p")
    mean = b.groupBy(*keys).agg(F.avg("_p").alias("_m"))
    return b.join(mean, keys).filter(level(F.col("_p")) > level(F.col("_m")) - RELATIVE_GATE).groupBy(*keys).agg(level(F.avg("_p")).alias("lufs"))


def levels(audio: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lufs, peak, crest, seconds) of recordings from chunk rows: one pass over samples, the rest over cells of 100 ms."""
    from tessitura.session import materialize

    c = cells(audio).groupBy(*keys, "cell").agg(F.sum("weighted").alias("weighted"), F.sum("squared").alias("squared"), F.max("peak").alias("peak"), F.sum("n").alias("n"))
    c = materialize(c, "loudness-cells")  # read twice
    rms = F.sqrt(F.sum("squared") / F.sum("n"))
    whole = c.groupBy(*keys).agg(F.max("peak").alias("peak"), F.when(rms > 0, F.max("peak") / rms).alias("crest"), (F.sum("n") / float(SAMPLE_RATE)).alias("seconds"))
    return whole.join(gated(c, keys), keys, "left").select(*keys, "lufs", "peak", "crest", "seconds")


FIXTURES = {"frame_band": ["track", "source", "frame", *BANDS], "frame_level": ["track", "source", "frame", "rms"], "frame_f0": ["track", "source", "frame", "f0_hz", "voiced", "voiced_prob"]}


def write_fixtures(audio: DataFrame, root: str, only: list[str] | None = None) -> None:
    """Derived tables of recordings as Parquet under ``root``, one folder each, by track: all of FIXTURES or some."""
    names = only or list(FIXTURES)
    frames = frame_bands(audio)
    for name in names:
        rows = pitch(audio) if name == "frame_f0" else frames
        rows.select(*FIXTURES[name]).write.mode("overwrite").partitionBy("track").parquet(f"{root}/{name}")


def read_fixture(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the tables that ``write_fixtures`` wrote."""
    return spark.read.parquet(f"{root}/{name}").select(*FIXTURES[name])
