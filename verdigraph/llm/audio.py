"""Audio features of byte payloads: 8-bit WAV, polyphase resampling, log-mel frames, hysteresis segments, fixed-shape Arrow tensors.

A payload is stored losslessly as the samples of an 8-bit mono WAV file. From the stored file come: samples resampled by UP / DOWN with
a polyphase windowed-sinc filter; overlapped frames under a Hann window; log energies of a mel filterbank; segments that begin where a
frame's level reaches ON and end where it falls under OFF; and the frames cut into blocks of BLOCK x MELS, one fixed-shape tensor
each, with the time span that it covers, as an Arrow stream. Media and tensors are stored in tables; digests are of what is read back.

Defined results: a null text is an empty one; payloads are padded with bytes 32 to a positive multiple of 192, so there is always a
frame; equal texts give equal bytes; a last block is filled up with the floor level and says how many frames are real; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, stored, table, text_bytes

UNIT, PAD = 192, b" "
RATE = 8000
UP, DOWN, TAPS = 3, 4, 16
FRAME, HOP, MELS, BLOCK = 192, 96, 32, 64
ON, OFF = 0.35, 0.25
FLOOR = 1e-6
#: Rows that are held at a time.
ROWS = 256


def payload_of(text: bytes) -> bytes:
    return text + PAD * (UNIT - len(text) if not text else -len(text) % UNIT)


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono PCM file."""
    odd = b"\0" * (len(samples) & 1)
    form = b"".join(n.to_bytes(size, "little") for n, size in ((1, 2), (1, 2), (rate, 4), (rate, 4), (1, 2), (8, 2)))
    body = b"WAVEfmt " + (16).to_bytes(4, "little") + form + b"data" + len(samples).to_bytes(4, "little") + samples + odd
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def read_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of such a file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, RATE
    while at + 8 <= len(media):
        size = int.from_bytes(media[at + 4 : at + 8], "little")
        if media[at : at + 4] == b"fmt ":
            rate = int.from_bytes(media[at + 12 : at + 16], "little")
        elif media[at : at + 4] == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def _lowpass() -> np.ndarray:
    """UP rows of TAPS coefficients: the phases of a windowed sinc that cuts at the lower of both rates."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    cut = min(1 / UP, 1 / DOWN)
    h = np.sinc(t * cut) * np.hanning(n + 2)[1:-1]
    return (h / h.sum() * UP).reshape(TAPS, UP).T.astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """x at UP / DOWN times its rate. Output m lies at input (m * DOWN) / UP: its remainder is the filter phase."""
    phases = _lowpass()
    n = len(x) * UP // DOWN
    y = np.zeros(n, np.float32)
    edge = np.concatenate([np.zeros(TAPS // 2, np.float32), x, np.zeros(TAPS, np.float32)])
    for r in range(UP):
        count = len(range(r, n, UP))
        first, phase = divmod(r * DOWN, UP)
        for tap in range(TAPS):
            part = edge[first + TAPS - 1 - tap :: DOWN][:count]
            y[r::UP][: len(part)] += phases[phase, tap] * part
    return y


def mel_bank(rate: float) -> np.ndarray:
    """FRAME // 2 + 1 by MELS triangles, evenly spaced in mel."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, FRAME // 2 + 1)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(y: np.ndarray, bank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames by MELS log energies, and each frame's level (root mean square)."""
    if len(y) < FRAME:
        y = np.concatenate([y, np.zeros(FRAME - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    out, level = [], []
    for at in range(0, len(frames), 4096):  # bounded memory for very long payloads
        some = frames[at : at + 4096]
        power = np.abs(np.fft.rfft(some * window, axis=1)) ** 2
        out.append(np.log10(power.astype(np.float32) @ bank + np.float32(FLOOR)))
        level.append(np.sqrt((some * some).mean(axis=1)))
    return np.concatenate(out), np.concatenate(level)


def segments(level: np.ndarray, on: float = ON, off: float = OFF) -> list[tuple[int, int]]:
    """Frames [first, end) of each stretch that begins at a level of ``on`` and goes on until it is under ``off``."""
    told = np.where(level >= on, 1, np.where(level < off, 0, -1))
    last = np.maximum.accumulate(np.where(told >= 0, np.arange(len(told)), -1))
    state = np.where(last >= 0, told[np.maximum(last, 0)], 0)
    turns = np.flatnonzero(np.diff(np.concatenate([[0], state, [0]])))
    return [(int(a), int(b)) for a, b in zip(turns[::2], turns[1::2])]


def tensors(mel: np.ndarray, rate: float) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Blocks of BLOCK x MELS, and of each its start and end in ms and its real frames."""
    n = -(-len(mel) // BLOCK)
    full = np.full((n * BLOCK, MELS), np.log10(FLOOR), np.float32)
    full[: len(mel)] = mel
    real = [min(BLOCK, len(mel) - i * BLOCK) for i in range(n)]
    ms = lambda frame: int(frame * HOP * 1000 / rate)
    return full.reshape(n, BLOCK, MELS), [(ms(i * BLOCK), ms(i * BLOCK + k - 1) + int(FRAME * 1000 / rate), k) for i, k in enumerate(real)]


def tensor_stream(blocks: np.ndarray, spans: list[tuple[int, int, int]]) -> bytes:
    """An Arrow stream of a fixed-shape tensor column (half precision) and its time spans."""
    columns = [pa.FixedShapeTensorArray.from_numpy_ndarray(blocks.astype(np.float16)), *(pa.array([s[i] for s in spans], pa.int32()) for i in range(3))]
    batch = pa.RecordBatch.from_arrays(columns, ["tensor", "start_ms", "end_ms", "frames"])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue()


def read_tensors(stream: bytes) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Blocks and spans of such a stream."""
    t = pa.ipc.open_stream(stream).read_all().combine_chunks()
    blocks = t.column("tensor").combine_chunks().to_numpy_ndarray().astype(np.float32)
    return blocks, list(zip(*(t.column(c).to_pylist() for c in ("start_ms", "end_ms", "frames"))))


class Features:
    def __init__(self) -> None:
        self.bank, self.rate = None, None

    def __call__(self, media: bytes):
        """Samples, tensor blocks, spans and segments of a stored file."""
        samples, rate = read_wav(media)
        if rate != self.rate:
            self.bank, self.rate = mel_bank(rate * UP / DOWN), rate
        x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
        mel, level = log_mel(resample(x), self.bank)
        blocks, spans = tensors(mel, rate * UP / DOWN)
        return samples, blocks, spans, segments(level)


def stored_media(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, n_bytes and media, the WAV file of each text, in a table of the shared folder."""

    def store(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = text_bytes(part, "text")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([wav(payload_of(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return stored(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(released(store), "doc_id long, n_bytes long, media binary"), "media", "zstd")


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensors binary, segments array<struct<start: int, end: int>>"


def audio_features(media: DataFrame) -> DataFrame:
    """Of stored media: what was read back, tensors (an Arrow stream), and segments (frames); in a table of the shared folder."""

    def compute(batches):
        features = Features()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = []
                for m in part.column(2).to_pylist():
                    samples, blocks, spans, found = features(m)
                    told = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(m), hashlib.sha256(m).hexdigest())
                    rows.append((*told, tensor_stream(blocks, spans), [{"start": a, "end": b} for a, b in found]))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *columns], [c.split(":")[0].split()[0] for c in STORED.split(", ", 8)])

    return stored(media.select("doc_id", "n_bytes", "media").mapInArrow(released(compute), STORED), "features", "zstd")


def digest(blocks: np.ndarray, spans: list, found: list) -> str:
    """Frames, segments, mean level of each mel band in hundredths, and a hash of the tensors rounded to hundredths."""
    real = sum(s[2] for s in spans)
    hundredths = np.rint(blocks * 100).astype(np.int16)
    mean = np.rint(blocks.reshape(-1, MELS)[:real].mean(axis=0, dtype=np.float64) * 100).astype(int)
    told = hashlib.blake2b(hundredths.tobytes() + repr((spans, found)).encode(), digest_size=12).hexdigest()
    return f"frames={real};blocks={len(spans)};end_ms={spans[-1][1]};segments={len(found)};mel={','.join(map(str, mean))};tensors={told}"


def op3_audio_features(spark, sf_dir: str) -> DataFrame:
    found = audio_features(stored_media(table(spark, sf_dir, "documents"), "doc_id", "text"))

    def told(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                both = zip(part.column(7).to_pylist(), part.column(8).to_pylist())
                features = [digest(*read_tensors(t), [(x["start"], x["end"]) for x in some]) for t, some in both]
                yield pa.RecordBatch.from_arrays([*part.columns[:7], pa.array(features, pa.string())], [*part.schema.names[:7], "feature"])

    return found.mapInArrow(released(told), STORED.split(", tensors")[0] + ", feature string")
