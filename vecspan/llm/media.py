"""Media columns: payloads stored as WAV, with spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

RATE = 8_000
FRAME = 192
HOP = 96
BANDS = ((1, 33), (33, 97))
STEPS = (1, 2, 4)  #: frames between the peaks of a pair
BLOCK = 8_192  #: frames transformed at once; bounds memory for long payloads
UNIT = 192
_HANN = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file with 8-bit samples, one for each byte of the payload."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a mono 8-bit WAV file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("mono 8-bit samples are expected")
        return w.readframes(w.getnframes())


def _peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per frame and band, the strongest bin and its magnitude."""
    frames = max(1, 1 + (len(samples) - FRAME) // HOP)
    if len(samples) < FRAME:
        samples = np.concatenate([samples, np.zeros(FRAME - len(samples), samples.dtype)])
    bins, strengths = np.empty((frames, len(BANDS)), np.int64), np.empty((frames, len(BANDS)), np.float32)
    view = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for at in range(0, frames, BLOCK):
        spectrum = np.abs(np.fft.rfft(view[at : at + BLOCK] * _HANN, axis=1))
        for k, (low, high) in enumerate(BANDS):
            best = spectrum[:, low:high].argmax(1)
            bins[at : at + BLOCK, k] = best + low
            strengths[at : at + BLOCK, k] = np.take_along_axis(spectrum[:, low:high], best[:, None], 1)[:, 0]
    return bins, strengths


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes): pairs of spectral peaks, in the order of their time.

    Short-time Fourier transforms (Hann frames of 192 samples, every 96) give each frame's strongest bin
    in a low and a high band. A peak at least as strong as its band's peaks in the frames beside it is
    an anchor, and is paired with the peaks of both bands 1, 2 and 4 frames later. ``times``
    (int32) is the anchor's frame; ``codes`` (int32) packs the anchor's bin, the other bin and the distance.
    """
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    bins, strengths = _peaks(x)
    edge = np.full((1, len(BANDS)), -1, np.float32)
    anchor = (strengths >= np.concatenate([edge, strengths[:-1]])) & (strengths >= np.concatenate([strengths[1:], edge])) & (strengths > 0)
    times, codes = [], []
    for k in range(len(BANDS)):
        t = np.flatnonzero(anchor[:, k])
        for step in STEPS:
            s = t[t + step < len(bins)]
            for other in range(len(BANDS)):
                times.append(s)
                codes.append(bins[s, k] << 16 | bins[s + step, other] << 8 | step)
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order].astype("<i4"), code[order].astype("<i4")


def text_payload(text: str | None, unit: int = UNIT) -> tuple[bytes, int]:
    """A text's UTF-8, filled with spaces to a positive multiple of ``unit``; and its length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b" "), len(raw)


def media_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, times, codes) of each row: its text as a WAV file and its fingerprint.

    Null and empty texts become 192 blanks, whose constant samples have no peaks in most bins but
    a defined result. Repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _pieces(batches):
            rows = []
            for text in texts:
                payload, n = text_payload(text)
                media = to_wav(payload)
                rows.append((n, media, *fingerprint(from_wav(media))))
            lists = pa.list_(pa.int32())
            n, media, times, codes = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(times, lists), pa.array(codes, lists)], ["doc_id", "n_bytes", "media", "times", "codes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary, times array<int>, codes array<int>")


def _pieces(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[tuple[list, list]]:
    for batch in batches:
        ids, texts, held = [], [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids.append(doc_id)
            texts.append(text)
            held += len(text or "")
            if held > limit:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts


def media_digests(docs: DataFrame) -> DataFrame:
    """Digests of ``media_columns``, taken where the media are made, so that they needn't be moved."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _pieces(batches):
            rows = []
            for doc_id, text in zip(ids, texts):
                payload, n = text_payload(text)
                media = to_wav(payload)
                back = from_wav(media)
                times, codes = fingerprint(back)
                feature = f"{len(times)}:{xxhash.xxh3_128_hexdigest(times.tobytes() + codes.tobytes())}"
                rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
