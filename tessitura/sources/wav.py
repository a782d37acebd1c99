"""WAV files as a Spark data source: ``spark.read.format("wav").load(path)``.

A partition is a range of bytes of one file, so a long recording is read by many tasks; each opens the file, reads the
header and the samples that its chunks of frames need, and no more. Listing takes names and sizes alone. Files are opened
through Arrow's file systems (local, HDFS, object stores).

A file that can't be read is one row with its ``error`` and no samples; it ends no other file's reading.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessitura.functions.scalars import HOP, N_FFT, SAMPLE_RATE
from tessitura.sources import audio

#: Bytes of a file that one task reads, unless the option ``partitionBytes`` says otherwise.
PARTITION_BYTES = 32 << 20
HEADER_BYTES = 1 << 16
#: Samples that are held in memory before they are written.
WRITE_SAMPLES = 1 << 20
SCHEMA = "track string, source string, chunk bigint, samples array<float>, before array<float>, after array<float>, total bigint, path string, channels int, error string"


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int
    size: int


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WavReader(self.options)


class WavReader(DataSourceReader):
    """Chunk rows of the files <track>/<source>.wav under the option ``path``."""

    def __init__(self, options):
        self.path = options["path"]
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(at)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(at, recursive=True))
        wavs = sorted((f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(".wav"))
        return [Range(p, a, a + self.bytes, size) for p, size in wavs for a in range(0, max(size, 1), self.bytes)]

    def read(self, partition: Range):
        from pyarrow import fs

        *_, track, name = ["", *partition.path.split("/")]
        source = name.rsplit(".", 1)[0]
        try:
            system, _ = fs.FileSystem.from_uri(self.path)
            with system.open_input_file(partition.path) as f:
                head = header(f.read(HEADER_BYTES), partition.size)
                for c, parts in chunks(f, head, partition):
                    cols = [[track], [source], [c], *[[p] for p in parts], [head.total], [partition.path], [head.channels], [None]]
                    yield batch(cols)
        except (ValueError, struct.error, OSError) as e:
            if partition.start == 0:
                yield batch([[track], [source], [None], [None], [None], [None], [None], [partition.path], [None], [str(e)]])


def batch(cols: list[list]) -> pa.RecordBatch:
    floats = pa.list_(pa.float32())
    kinds = [pa.string(), pa.string(), pa.int64(), floats, floats, floats, pa.int64(), pa.string(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


@dataclass
class Head:
    code: int
    channels: int
    rate: int
    bits: int
    data: int
    frames: int

    @property
    def step(self) -> int:
        return self.channels * self.bits // 8

    @property
    def total(self) -> int:
        """Samples at the rate of the analysis."""
        return self.frames if self.rate == SAMPLE_RATE else int(round(self.frames * SAMPLE_RATE / self.rate))


def header(raw: bytes, size: int) -> Head:
    """Format and place of the samples; the data may be shorter than the header says."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind = 12, None
    while at + 8 <= len(raw):
        tag, n = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
        if tag == b"fmt ":
            kind = struct.unpack("<HHIIHH", raw[at + 8 : at + 24])
            if kind[0] == 0xFFFE:
                kind = (struct.unpack("<H", raw[at + 32 : at + 34])[0], *kind[1:])
        elif tag == b"data" and kind:
            code, channels, rate, _, _, bits = kind
            if not channels or not rate or (code, bits) not in audio.ENCODINGS:
                raise ValueError(f"format {code} of {bits} bits isn't supported")
            return Head(code, channels, rate, bits, at + 8, min(n, size - at - 8) // (channels * bits // 8))
        at += 8 + n + n % 2
    raise ValueError("no format or data in the WAV file")


def span(f, head: Head, start: int, stop: int) -> np.ndarray:
    """Mono samples [start, stop) at the file's own rate, silence beyond its ends."""
    a, b = min(max(0, start), head.frames), max(0, min(stop, head.frames))
    out = np.zeros(stop - start, np.float32)
    if b > a:
        f.seek(head.data + a * head.step)
        x = audio.to_mono(audio.decode_samples(f.read((b - a) * head.step), head.code, head.channels, head.bits))
        out[a - start : a - start + len(x)] = x
    return out


def chunks(f, head: Head, part: Range, frames: int = audio.CHUNK_FRAMES):
    """(chunk, (samples, before, after)) of the chunks whose first sample lies in the bytes of ``part``."""
    count = -(-(1 + head.total // HOP) // frames)
    per_chunk = frames * HOP * head.rate / SAMPLE_RATE * head.step  # bytes of the file a chunk
    first = max(0, int(np.ceil((part.start - head.data) / per_chunk))) if part.start > head.data else 0
    for c in range(first, count):
        at = head.data + int(c * per_chunk)
        if c and at >= part.stop:
            return
        if c and at < part.start:
            continue
        start, stop = audio.chunk_span(c, head.total, frames)
        low, high = start - audio.BEFORE, stop + audio.AFTER
        if head.rate == SAMPLE_RATE:
            x = span(f, head, low, high)
        else:
            x = resampled(f, head, low, high)
        cut = len(x) - audio.AFTER
        yield c, (x[audio.BEFORE : cut], x[: audio.BEFORE], x[cut:])


def resampled(f, head: Head, low: int, high: int) -> np.ndarray:
    """Samples [low, high) at the rate of the analysis, silence beyond the recording, as ``audio.resample`` of the whole gives them."""
    a, b = max(0, low), min(high, head.total)
    out = np.zeros(high - low, np.float32)
    if b > a:
        reach = audio.resample_reach(head.rate)
        i, j = max(0, int(a * head.rate / SAMPLE_RATE) - reach), min(head.frames, int(b * head.rate / SAMPLE_RATE) + reach + 1)
        out[a - low : b - low] = audio.resample_part(span(f, head, i, j), head.rate, a, b, i)
    return out


def read_chunks(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Rows of SCHEMA for the recordings under ``path``."""
    spark.dataSource.register(WavSource)
    return spark.read.format("wav").option("partitionBytes", partition_bytes).load(path)


def write_recordings(values: DataFrame, root: str, hold: int = 1) -> DataFrame:
    """Writes <root>/<track>/<source>.wav of 16 bits from (track, source, i, value) within -1 and 1, each value held for ``hold`` samples; (track, source, path, total).

    One group is one recording, of which a task holds the values but only ``WRITE_SAMPLES`` of the held samples. A task that runs again
    writes the same bytes.
    """

    def run(key, table):
        from pyarrow import fs

        track, source = (str(k.as_py()) for k in key)  # as they are read back from the path
        order = np.argsort(table["i"].to_numpy(), kind="stable")
        x = np.rint(np.clip(table["value"].to_numpy()[order], -1, 1) * 32767).astype("<i2")
        total, step = len(x) * hold, max(1, WRITE_SAMPLES // hold)
        system, at = fs.FileSystem.from_uri(root)
        system.create_dir(f"{at}/{track}", recursive=True)
        with system.open_output_stream(f"{at}/{track}/{source}.wav") as out:
            out.write(b"RIFF" + struct.pack("<I", 36 + 2 * total) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, SAMPLE_RATE, 2 * SAMPLE_RATE, 2, 16) + b"data" + struct.pack("<I", 2 * total))
            for a in range(0, len(x), step):
                out.write(np.repeat(x[a : a + step], hold).tobytes())
        return pa.table({"track": [track], "source": [source], "path": [f"{root}/{track}/{source}.wav"], "total": pa.array([total], pa.int64())})

    return values.select("track", "source", "i", "value").groupBy("track", "source").applyInArrow(run, "track string, source string, path string, total bigint")
