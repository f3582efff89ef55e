"""Audio features of a media column.

A media column holds WAV files of one channel in unsigned 8-bit samples.  Features of each:
polyphase resampling by 3/4, overlapped frames through a mel filterbank, their logarithms
as fixed-shape Arrow tensors with time spans, and segments found by hysteresis on the
frames' energy.
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

from .common import small_batches, text_of

RATE, UP, DOWN, TAPS = 8000, 3, 4, 24
NEW_RATE = RATE * UP // DOWN
FRAME, HOP, MELS = 256, 128, 24
#: Frames of one stored tensor, and frames computed at a time.
TENSOR_FRAMES, BLOCK = 16, 4096
#: A segment opens at OPEN deviations over a file's mean level and closes below CLOSE.
OPEN, CLOSE = 1.0, 0.0
UNIT = 192
#: Log energies are stored in half precision: three digits, and half the bytes.
TENSOR = pa.fixed_shape_tensor(pa.float16(), (TENSOR_FRAMES, MELS))


def _resampler() -> np.ndarray:
    """TAPS x UP: the phases of a windowed sinc that cuts at the lower of both Nyquist rates."""
    at = np.arange(TAPS)[:, None] - (TAPS // 2 - 1) - np.arange(UP)[None, :] * DOWN / UP
    cut = min(1.0, UP / DOWN)
    window = np.cos(np.pi * np.clip(at / TAPS, -0.5, 0.5)) ** 2
    h = cut * np.sinc(cut * at) * window
    return (h / h.sum(axis=0)).astype(np.float32)


def _mel_bank() -> np.ndarray:
    """(FRAME / 2 + 1) x MELS triangles, evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40.0), mel(NEW_RATE / 2), MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, 1 / NEW_RATE)[:, None]
    rise = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


RESAMPLER, BANK = _resampler(), _mel_bank()
WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def wav(payload: bytes) -> bytes:
    """A WAV file of the bytes as unsigned 8-bit samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\x00" * (len(payload) % 2)


def samples(media: bytes) -> bytes:
    """The data of a WAV file of this kind; ValueError for anything else."""
    if len(media) < 44 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt " and struct.unpack_from("<HH", media, at + 8) + struct.unpack_from("<H", media, at + 22) != (1, 1, 8):
            raise ValueError("not one channel of 8-bit samples")
        if name == b"data":
            if at + 8 + size > len(media):
                raise ValueError("the data is cut off")
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data in the file")


def payload_of(text: str) -> bytes:
    """UTF-8, filled with spaces up to a positive multiple of 192 bytes."""
    data = text.encode("utf-8", "surrogatepass")
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")


def resample(x: np.ndarray) -> np.ndarray:
    """8 kHz to 6 kHz: each step of DOWN samples gives UP, a product of its neighbourhood with the phases."""
    padded = np.concatenate([np.zeros(TAPS // 2 - 1, np.float32), x, np.zeros(TAPS, np.float32)])
    near = np.lib.stride_tricks.sliding_window_view(padded, TAPS)[: len(x) : DOWN]
    return (near @ RESAMPLER).reshape(-1)


def log_mel(x: np.ndarray) -> np.ndarray:
    """Frames x MELS: logarithms of the mel energies of half overlapped Hann frames.  At least one frame."""
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(x)] = x
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    out = np.empty((n, MELS), np.float32)
    for i in range(0, n, BLOCK):
        spectrum = np.fft.rfft(frames[i : i + BLOCK] * WINDOW, axis=1)
        out[i : i + BLOCK] = np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ BANK + np.float32(1e-6))
    return out


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Spans of frames: from a level at or over the upper threshold until it falls under the lower one."""
    level = mel.mean(axis=1, dtype=np.float64)
    spread = level.std()
    if spread < 1e-9:
        return []
    z = (level - level.mean()) / spread
    state = np.where(z >= OPEN, 1, np.where(z < CLOSE, 0, -1))
    state[0] = max(state[0], 0)
    # in between, the state stays what it was last
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(z)), 0))
    on = np.concatenate([[0], state[known], [0]])
    edges = np.flatnonzero(np.diff(on))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream of (mel: fixed-shape tensor, start_s, end_s); the last tensor is filled with its last frame."""
    n = len(mel)
    count = -(-n // TENSOR_FRAMES)
    full = np.concatenate([mel, np.repeat(mel[-1:], count * TENSOR_FRAMES - n, axis=0)])
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1).astype(np.float16)), TENSOR_FRAMES * MELS)
    first = np.arange(count) * TENSOR_FRAMES
    last = np.minimum(first + TENSOR_FRAMES, n) - 1
    batch = pa.record_batch([pa.ExtensionArray.from_storage(TENSOR, storage), pa.array(first * HOP / NEW_RATE), pa.array((last * HOP + FRAME) / NEW_RATE)], ["mel", "start_s", "end_s"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    with pa.ipc.open_stream(stream) as reader:
        return reader.read_all()


def mel_of(stream: bytes) -> np.ndarray:
    """The frames of a stream of ``tensors``, without the filling of its last tensor."""
    found = read_tensors(stream)
    storage = found["mel"].combine_chunks().storage
    n = round((found["end_s"][-1].as_py() * NEW_RATE - FRAME) / HOP) + 1
    return storage.flatten().to_numpy().reshape(-1, MELS)[:n]


def describe(mel: np.ndarray, spans: list[tuple[int, int]]) -> str:
    """Frames, segments, frames within segments, and each band's mean and deviation in hundredths."""
    numbers = [len(mel), len(spans), sum(b - a for a, b in spans)]
    wide = mel.astype(np.float64)
    means, spread = wide.mean(axis=0), wide.std(axis=0)
    return ":".join([",".join(map(str, numbers)), *(",".join(str(int(round(100 * v))) for v in x) for x in (means, spread))])


def to_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media) of each row: its text as a WAV file.

    Null texts are empty; null and repeated ids keep their rows; an empty table gives an
    empty one.  No other columns are carried, so none can clash.
    """
    small_batches(docs)
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column("text").to_pylist()
                sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array([wav(payload_of(t)) for t in texts], pa.binary())], ["id", "n_bytes", "media"])

    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame, *, media_col: str = "media", with_tensors: bool = False, drop_media: bool = True) -> DataFrame:
    """Add the features of ``media_col`` to each row.

    Added: payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes), media_bytes,
    media_sha256, feature, and with ``with_tensors`` also tensors (an Arrow stream with a
    fixed-shape tensor column) and segments (start_s, end_s).  Every file is computed alone,
    so equal files have equal values.  A null file has null features; one that can't be read
    fails.  Input columns of these names are replaced; an empty table gives an empty result.
    """
    names = [x.split()[0] for x in FEATURES.split(", ")] + ["tensors", "segments"] * with_tensors
    kept = [c for c in media.columns if c not in names and not (drop_media and c == media_col)]

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(names)
        payload = samples(data)
        mel = log_mel(resample((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128))
        spans = segments(mel)
        out = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), describe(mel.astype(np.float16), spans))
        if with_tensors:
            out += (tensors(mel), [{"start_s": a * HOP / NEW_RATE, "end_s": ((b - 1) * HOP + FRAME) / NEW_RATE} for a, b in spans])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), span]
        for batch in batches:
            rows = [one(m.as_py()) for m in batch.column(media_col)]
            columns = [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + columns, kept + names)

    fields = [f"`{c}` {media.schema[c].dataType.simpleString()}" for c in kept] + [FEATURES]
    if with_tensors:
        fields.append("tensors binary, segments array<struct<start_s: double, end_s: double>>")
    return media.select(*kept, *([media_col] if media_col not in kept else [])).mapInArrow(run, ", ".join(fields))


def described(stored: DataFrame) -> DataFrame:
    """Replace tensors and segments, as ``features`` made them, by the feature that they give."""
    small_batches(stored)
    kept = [c for c in stored.columns if c not in ("tensors", "segments", "feature")]

    def one(stream: bytes | None, spans: list[dict] | None) -> str | None:
        if stream is None:
            return None
        return describe(mel_of(stream), [(round(s["start_s"] * NEW_RATE / HOP), round((s["end_s"] * NEW_RATE - FRAME) / HOP) + 1) for s in spans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(t.as_py(), s.as_py()) for t, s in zip(batch.column("tensors"), batch.column("segments"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found, pa.string())], [*kept, "feature"])

    fields = [f"`{c}` {stored.schema[c].dataType.simpleString()}" for c in kept] + ["feature string"]
    return stored.select(*kept, "tensors", "segments").mapInArrow(run, ", ".join(fields))
