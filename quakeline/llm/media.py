"""Media columns: a text as audio samples, with features of the stored samples.

The bytes of a text are the unsigned 8-bit samples of a mono wave file. From the file as read back come: polyphase
resampling by 3/4, overlapped log-mel filterbanks, and segments by a hysteresis of frame energy. The bands are held
as fixed-shape Arrow tensors, one for each clip of CLIP frames, with the time span of the clip. The columns are written
to the shared folder, and all digests and features are worked out from what is read back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeline.llm.common import stored
from quakeline.llm.tokens import few_rows

RATE, UP, DOWN, TAPS = 16_000, 3, 4, 24
FRAME, HOP, BANDS, CLIP = 512, 256, 32, 16
STEP = HOP / (RATE * UP / DOWN)
#: Energy in decibels over the mean at which a segment starts, and below which it ends.
LOUD, QUIET = 0.75, 0.0
#: Frames that are transformed together, so that long texts need no more memory than short ones.
TOGETHER = 1024


def wave_bytes(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF wave file of unsigned 8-bit mono samples."""
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload))
    pad = b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(head) + len(payload) + len(pad)) + head + payload + pad


def wave_payload(data: bytes) -> bytes:
    """The samples of such a file, found by walking its chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no wave file")
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"data":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a wave file without samples")


@cache
def _phases() -> np.ndarray:
    """Windowed-sinc low-pass as a matrix: DOWN inputs move on, UP outputs come out; column p is phase p."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(UP, DOWN)
    h = (UP * cut * np.sinc(cut * t) * np.hamming(n)).astype(np.float32)
    out = np.zeros((TAPS + DOWN, UP), np.float32)
    for p in range(UP):
        shift, phase = divmod(p * DOWN, UP)
        taps = h[phase::UP][:TAPS]
        out[shift : shift + TAPS, p] = taps[::-1]
    return out


def resampled(raw: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Samples lo to hi (at most the length) of unsigned 8-bit samples at UP / DOWN of their rate, by polyphase filtering."""
    filters = _phases()
    first, last = lo // UP, -(-hi // UP)
    at = first * DOWN - TAPS // 2
    padded = np.zeros((last - first - 1) * DOWN + len(filters), np.float32)
    part = raw[max(0, at) : at + len(padded)]
    padded[max(0, -at) : max(0, -at) + len(part)] = (part.astype(np.float32) - 128) / 128
    y = (np.lib.stride_tricks.sliding_window_view(padded, len(filters))[::DOWN] @ filters).reshape(-1)
    return y[lo - first * UP : hi - first * UP]


@cache
def _mel() -> tuple[np.ndarray, np.ndarray]:
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), BANDS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1) * rate / FRAME
    up, down = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32), np.hanning(FRAME).astype(np.float32)


def log_mel(raw: np.ndarray) -> np.ndarray:
    """Overlapped frames of resampled samples as log energies of mel bands, one row each; the last is filled up with silence.

    TOGETHER frames are worked out at a time, whatever the length.
    """
    bank, window = _mel()
    length = UP * -(-len(raw) // DOWN)
    n = max(1, -(-(length - FRAME) // HOP) + 1)
    out = np.empty((n, BANDS), np.float32)
    for lo in range(0, n, TOGETHER):
        hi = min(n, lo + TOGETHER)
        padded = np.zeros((hi - lo - 1) * HOP + FRAME, np.float32)
        y = resampled(raw, lo * HOP, min(length, lo * HOP + len(padded)))
        padded[: len(y)] = y
        spectrum = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP] * window, axis=1)
        out[lo:hi] = np.log10((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ bank + 1e-6)
    return out


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans that start above LOUD and go on until energy falls below QUIET (decibels over the mean)."""
    level = energy - energy.mean()
    state = np.where(level >= LOUD, 1, np.where(level < QUIET, -1, 0))
    known = np.flatnonzero(state)
    if not len(known):
        return []
    last = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = np.where(last >= 0, state[np.maximum(last, 0)] == 1, False)
    edge = np.flatnonzero(np.diff(on.astype(np.int8), prepend=0, append=0))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def tensors(mel: np.ndarray) -> pa.RecordBatch:
    """clip: fixed-shape tensors of CLIP frames by BANDS in half precision; start_s, end_s: the span of each, without the filling."""
    clips = -(-len(mel) // CLIP)
    full = np.zeros((clips * CLIP, BANDS), np.float16)
    full[: len(mel)] = mel
    first = np.arange(clips) * CLIP
    return pa.record_batch(
        [pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(clips, CLIP, BANDS)), pa.array(first * STEP), pa.array(np.minimum(first + CLIP, len(mel)) * STEP)], ["clip", "start_s", "end_s"]
    )


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def frames(data: bytes) -> np.ndarray:
    """The frames in packed tensors, without the filling."""
    with pa.ipc.open_stream(pa.py_buffer(data)) as reader:
        table = reader.read_all()
    clips = table.column("clip").combine_chunks()
    clips = clips.chunk(0) if isinstance(clips, pa.ChunkedArray) else clips
    n = round(table.column("end_s")[-1].as_py() / STEP)
    return clips.to_numpy_ndarray().reshape(-1, BANDS)[:n].astype(np.float32)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of a text (null: empty), filled with zeros to a positive multiple of 64, and its length before."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return raw + b"\0" * (-len(raw) % 64 or 64 * (not raw)), len(raw)


_COLUMNS = "doc_id long, n_bytes long, media binary, tensors binary, spans array<struct<start_s double, end_s double>>"
_DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_segments long, seconds double"
_SPANS = pa.list_(pa.struct({"start_s": pa.float64(), "end_s": pa.float64()}))


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in few_rows(batches, 64):
        lengths, files, clips, spans = [], [], [], []
        for text in part.column(1).to_pylist():
            raw, n = payload_of(text)
            file = wave_bytes(raw)
            mel = log_mel(np.frombuffer(wave_payload(file), np.uint8))
            lengths.append(n)
            files.append(file)
            clips.append(packed(tensors(mel)))
            spans.append([{"start_s": a * STEP, "end_s": b * STEP} for a, b in segments(10 * mel.mean(axis=1))])
        yield pa.record_batch([part.column(0), pa.array(lengths, pa.int64()), pa.array(files, pa.binary()), pa.array(clips, pa.binary()), pa.array(spans, _SPANS)], [x.split()[0] for x in _COLUMNS.split(", ")[:5]])


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a wave file), tensors (an Arrow stream of clips with their spans) and spans (segments) per row of docs (doc_id, text).

    Null texts count as empty. Repeated rows and equal texts get equal values; long texts are worked on in blocks; other
    columns don't matter, and an empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_columns, _COLUMNS)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _DIGESTS.split(", ")]
    for part in few_rows(batches, 64):
        rows = []
        for file, clips, spans in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            back, mel = wave_payload(file), frames(clips)
            means = mel.mean(axis=0, dtype=np.float64).reshape(8, -1).mean(axis=1)
            inside = sum(round((s["end_s"] - s["start_s"]) / STEP) for s in spans)
            feature = ",".join([f"{len(mel)}x{BANDS}", *(f"{v + 0.0:.2f}" for v in means), f"{len(spans)}:{inside}"])
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature, len(spans), len(back) / RATE))
        yield pa.record_batch([part.column(0), part.column(1), *(pa.array(x) for x in zip(*rows, strict=True))], names)


def digests(columns: DataFrame) -> DataFrame:
    """What the query reports of `media` columns: written first, then read back, each row by itself."""
    return stored(columns, "zstd").select("doc_id", "n_bytes", "media", "tensors", "spans").mapInArrow(_digested, _DIGESTS)
