"""Media columns: a payload kept as 8-bit samples in a WAV file, and audio features of the samples that are read back.

Features: polyphase resampling by 1/2, overlapped log-mel frames, and segments by energy with hysteresis, the frames of
each pooled to a tensor of fixed shape with its time span.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples a second of a payload; bytes to whose multiple a payload is padded.
RATE, MULTIPLE = 16000, 192
#: Frames after resampling (samples), mel bands, and the frames to which a segment is pooled.
FRAME, HOP, FFT, MELS, POOL = 200, 80, 256, 16, 4
#: A segment begins at a frame over the upper level and ends at one under the lower, in log energy over the median.
UPPER, LOWER = 0.35, 0.1
#: Frames worked on at a time.
BLOCK_FRAMES = 4096


def taps(n: int = 16) -> np.ndarray:
    """Windowed sinc that passes half the band; its two phases are the even and the odd taps."""
    at = np.arange(n) - (n - 1) / 2
    h = np.sinc(at / 2) * np.hamming(n)
    return h / h.sum()


def mel_bands() -> np.ndarray:
    """MELS triangular filters over the FFT bins of RATE / 2 samples a second."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(RATE / 4), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 2 / RATE)
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


TAPS, BANDS, WINDOW = taps(), mel_bands(), np.hanning(FRAME)


def pad(text: bytes) -> bytes:
    size = max(MULTIPLE, -(-len(text) // MULTIPLE) * MULTIPLE)
    return text.ljust(size, b" ")


def to_wav(payload: bytes) -> bytes:
    """Mono, 8 bits a sample, PCM."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file; walks over its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        if media[at : at + 4] == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def resample(x: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Half the rate: even samples through the even taps, odd ones through the odd taps, zeros beyond the ends.

    lo and hi choose some of the results; only the samples that these need are read.
    """
    half, n = len(TAPS) // 2, (len(x) + 1) // 2
    hi = n if hi is None else min(hi, n)
    first, last = 2 * lo - half, 2 * (hi - 1) + half
    own = np.concatenate([np.zeros(max(0, -first)), x[max(0, first) : last].astype(np.float64), np.zeros(max(0, last - max(len(x), first)))])
    even, odd = own[0::2], own[1::2]
    out = np.zeros(max(0, hi - lo))
    for k in range(half):
        out += TAPS[2 * k] * even[k : k + len(out)] + TAPS[2 * k + 1] * odd[k : k + len(out)]
    return out


def log_mel(samples: bytes) -> np.ndarray:
    """(frames, MELS) log-mel energies; the last frame is filled up with zeros, so there is one at least.

    Samples are resampled and transformed BLOCK_FRAMES frames at a time, so a long payload needs its own bytes and less than as
    many again for the energies.
    """
    raw = np.frombuffer(samples, dtype=np.uint8)
    n = (len(raw) + 1) // 2
    frames = max(1, -(-(n - FRAME) // HOP) + 1)
    out = np.empty((frames, MELS))
    for at in range(0, frames, BLOCK_FRAMES):
        some = min(BLOCK_FRAMES, frames - at)
        lo, hi = at * HOP, (at + some - 1) * HOP + FRAME
        begin, end = max(0, 2 * lo - len(TAPS)), 2 * hi + len(TAPS)
        x = resample((raw[begin:end].astype(np.float64) - 128) / 128, lo - begin // 2, min(hi, n) - begin // 2)
        x = np.concatenate([x, np.zeros(hi - lo - len(x))])
        view = np.lib.stride_tricks.as_strided(x, (some, FRAME), (x.strides[0] * HOP, x.strides[0]))
        power = np.abs(np.fft.rfft(view * WINDOW, FFT)) ** 2
        out[at : at + some] = np.log(power @ BANDS + 1e-6)
    return out


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames: a run begins over UPPER and goes on while not under LOWER. Levels count from the median."""
    x = energy - np.median(energy)
    mark = np.where(x > UPPER, 1, np.where(x < LOWER, -1, 0))
    at = np.flatnonzero(mark)
    if not len(at):
        return []
    state = np.zeros(len(x), dtype=bool)
    last = np.searchsorted(at, np.arange(len(x)), side="right") - 1
    state[last >= 0] = mark[at[last[last >= 0]]] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], state.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def features(samples: bytes) -> dict:
    """Segments with their time spans in seconds and pooled tensors of (POOL, MELS), quantised to hundredths.

    A payload without a segment has one that spans all of it.
    """
    mel = log_mel(samples)
    runs = segments(mel.mean(axis=1)) or [(0, len(mel))]
    sums = np.concatenate([np.zeros((1, MELS)), np.cumsum(mel, axis=0)])
    lo, hi = np.array(runs).T
    bounds = lo[:, None] + ((hi - lo)[:, None] * np.arange(POOL + 1)) // POOL
    first, last = bounds[:, :-1], np.maximum(bounds[:, 1:], bounds[:, :-1] + 1)
    last = np.minimum(last, len(mel))
    first = np.minimum(first, last - 1)
    pooled = (sums[last] - sums[first]) / (last - first)[:, :, None]
    second = 2 * HOP / RATE
    return {"frames": len(mel), "spans": [(a * second, b * second) for a, b in runs], "tensors": np.rint(pooled * 100).astype(np.int16)}


def tensor_column(tensors: np.ndarray) -> bytes:
    """(segments, POOL, MELS) as an Arrow stream with one column of fixed-shape tensors."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.ravel()), POOL * MELS)
    column = pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.int16(), (POOL, MELS)), flat)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("logmel", column.type)])) as w:
        w.write_batch(pa.RecordBatch.from_arrays([column], names=["logmel"]))
    return sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> np.ndarray:
    column = pa.ipc.open_stream(stored).read_all().column("logmel").combine_chunks()
    return column.storage.flatten().to_numpy().reshape(-1, POOL, MELS)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text, a null one as empty, padded and written as a WAV file.

    Ids may be null or repeat, and rows go through one by one. WAV counts bytes in 32 bits; a string of Spark is shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for at in range(0, len(texts), 256):
                some = [t or b"" for t in texts[at : at + 256]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array([len(t) for t in some], type=pa.int64()), pa.array([to_wav(pad(t)) for t in some], type=pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


#: Columns that audio_features adds to a media column; logmel is an Arrow stream of fixed-shape tensors, one a span.
ADDED = "payload_bytes long, payload_sha256 string, tail_crc32 long, frames long, spans array<struct<start_s:double,end_s:double>>, logmel binary"


def audio_features(media: DataFrame) -> DataFrame:
    """media (doc_id, n_bytes, media) with the columns ADDED: the samples are read back from the stored bytes."""
    spans_type = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), spans_type, pa.binary()]
    names = ["doc_id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "frames", "spans", "logmel"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some, rows = batch.slice(at, 256), []
                for stored in some.column("media"):
                    back = from_wav(stored.as_py())
                    f = features(back)
                    spans = [{"start_s": a, "end_s": b} for a, b in f["spans"]]
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), f["frames"], spans, tensor_column(f["tensors"])))
                yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array(list(c), type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return media.mapInArrow(run, f"doc_id long, n_bytes long, media binary, {ADDED}")


def digests(described: DataFrame) -> DataFrame:
    """Lengths and digests of what audio_features gives; feature names frames, segments, their time and the tensors' digest."""
    inside = F.aggregate("spans", F.lit(0.0), lambda s, x: s + x["end_s"] - x["start_s"])
    feature = F.concat(F.col("frames"), F.lit("f-"), F.size("spans"), F.lit("s-"), F.round(inside * 1000).cast("long"), F.lit("ms-"), F.substring(F.sha2("logmel", 256), 1, 16))
    return described.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
