"""Media columns: motion-JPEG in AVI, written and read losslessly, with clips between detected shots.

A payload of k * 576 bytes becomes k frames of 24 x 24 samples of 8 bits. Each frame is a lossless intra
JPEG (SOF3, predictor 1, one Huffman table) in an AVI file with RIFF headers, a `movi` list and an `idx1`
index. Reading walks the RIFF chunks, finds the frames by the index, parses each frame's own segments (Huffman
tables, size, predictor 1 to 7), and decodes the frames of a batch that have equal headers in lock-step: sample by
sample, vectorised over frames. Shots are cut where the histogram difference of
neighbouring frames passes a threshold that adapts to the differences around it; each shot is a clip with
its times.

Null counts as the empty text: one frame of 255. Equal payloads give equal files and features. Every row has its own
file, so repeated rows and null ids stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, in_arrow, runs

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
#: Frames decoded at once.
AT_ONCE = 6000
#: Bins of a frame's histogram; a cut needs mean + FACTOR * deviation of the differences at most REACH frames away, and LEAST itself.
BINS, REACH, FACTOR, LEAST = 16, 12, 2.0, 0.2

#: Code lengths of the nine difference categories 0..8; the all-ones code stays unused, as JPEG asks.
LENGTHS = (4, 4, 3, 3, 3, 3, 3, 3, 4)


def _codes() -> tuple[np.ndarray, bytes]:
    """Canonical codes by category, and the table's DHT segment."""
    order = sorted(range(len(LENGTHS)), key=lambda s: (LENGTHS[s], s))
    code, at, codes = 0, LENGTHS[order[0]], [0] * len(LENGTHS)
    for s in order:
        code <<= LENGTHS[s] - at
        at = LENGTHS[s]
        codes[s] = code
        code += 1
    counts = bytes(sum(n == k for n in LENGTHS) for k in range(1, 17))
    body = b"\x00" + counts + bytes(order)
    return np.array(codes, np.int64), b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


CODES, DHT = _codes()
HEAD = b"\xff\xd8" + DHT + b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0) + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
TAIL = b"\xff\xd9"

_diff = np.arange(-255, 256)
_CAT = np.array([int(abs(int(d))).bit_length() for d in _diff], np.int64)
_LEN = np.array(LENGTHS, np.int64)[_CAT] + _CAT
_VALUE = (CODES[_CAT] << _CAT) | np.where(_diff < 0, _diff + (1 << _CAT) - 1, _diff)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """samples: uint8 of shape (frames, SIDE, SIDE). The entropy-coded JPEG files."""
    k = len(samples)
    x = samples.astype(np.int64)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    d = d.reshape(k, FRAME) + 255
    length, value = _LEN[d], _VALUE[d]
    ends = np.cumsum(length, axis=1)
    used = (ends[:, -1] + 7) // 8
    base = np.concatenate([[0], np.cumsum(used)])
    at = (ends - length) + base[:-1, None] * 8
    byte = (at >> 3).ravel()
    word = (value << (24 - length - (at & 7))).ravel()
    total = int(base[-1])
    out = sum(np.bincount(byte + i, weights=(word >> (16 - 8 * i)) & 255, minlength=total + 2) for i in range(3))
    data = out[:total].astype(np.uint8)
    spare = used * 8 - ends[:, -1]
    data[base[1:] - 1] |= ((1 << spare) - 1).astype(np.uint8)  # a frame is filled up with ones
    full = data == 255
    stuffed = np.insert(data, np.flatnonzero(full) + 1, 0)
    more = np.concatenate([[0], np.cumsum(full)])
    cuts = base + more[base]
    raw = stuffed.tobytes()
    return [HEAD + raw[cuts[i] : cuts[i + 1]] + TAIL for i in range(k)]


@dataclass(frozen=True)
class Frame:
    """What the headers of a lossless JPEG file say, up to its entropy-coded data."""

    height: int
    width: int
    predictor: int
    bits: int  # of the longest code
    category: np.ndarray  # by the next `bits` bits; -1 where they begin no code
    length: np.ndarray


def parsed_head(f: bytes) -> tuple[Frame, int]:
    """The headers of one file and where its entropy-coded data begin. Raises ValueError for what is no lossless JPEG of one component with 8 bits."""
    if f[:2] != b"\xff\xd8":
        raise ValueError("a frame is no JPEG")
    at, tables, size = 2, {}, None
    while True:
        if at + 4 > len(f) or f[at] != 255:
            raise ValueError("a frame breaks off before its scan")
        marker, n = f[at + 1], struct.unpack_from(">H", f, at + 2)[0]
        body = f[at + 4 : at + 2 + n]
        if n < 2 or len(body) != n - 2:
            raise ValueError("a segment passes the end of its frame")
        at += 2 + n
        if marker == 0xC4:
            while body:
                counts = body[1:17]
                k = sum(counts)
                if len(counts) < 16 or len(body) < 17 + k:
                    raise ValueError("a Huffman table breaks off")
                tables[body[0]] = (counts, body[17 : 17 + k])
                body = body[17 + k :]
        elif marker == 0xC3:
            if len(body) < 9 or body[0] != 8 or body[5] != 1:
                raise ValueError("a frame has not one component of 8 bits")
            size = struct.unpack_from(">HH", body, 1)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("a frame is no lossless JPEG")
        elif marker == 0xDD and body != b"\0\0":
            raise ValueError("restart intervals are not supported")
        elif marker == 0xDA:
            if size is None or len(body) < 6 or body[0] != 1 or body[2] >> 4 not in tables or not 1 <= body[3] <= 7 or body[5]:
                raise ValueError("a scan that is not supported")
            return Frame(*size, body[3], *_lookup(*tables[body[2] >> 4])), at


def _lookup(counts: bytes, symbols: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Canonical codes of a DHT segment as tables by the next bits."""
    bits = max((i for i, c in enumerate(counts, 1) if c), default=1)
    category, length = np.full(1 << bits, -1, np.int64), np.ones(1 << bits, np.int64)
    code = at = 0
    for n, c in enumerate(counts, 1):
        for s in symbols[at : at + c]:
            lo = code << (bits - n) if n <= bits else 0
            if s > 15 or lo >= 1 << bits:
                raise ValueError("a Huffman table that is not supported")
            category[lo : lo + (1 << (bits - n))], length[lo : lo + (1 << (bits - n))] = s, n
            code += 1
        at += c
        code <<= 1
    return bits, category, length


@lru_cache(maxsize=64)
def _head_of(head: bytes) -> tuple[Frame, int]:
    return parsed_head(head)


def _scan_at(f: bytes) -> int:
    """Where the entropy-coded data begin, by the lengths of the segments."""
    at = 2
    while at + 4 <= len(f) and f[at + 1] != 0xDA:
        at += 2 + struct.unpack_from(">H", f, at + 2)[0]
    return at + 2 + struct.unpack_from(">H", f, at + 2)[0] if at + 4 <= len(f) else len(f)


def decode_frames(files: list[bytes]) -> list[np.ndarray]:
    """The samples of lossless JPEG files, uint8 of shape (height, width) each; files with equal headers are decoded together."""
    by: dict[bytes, list[int]] = {}
    for i, f in enumerate(files):
        by.setdefault(f[: _scan_at(f)], []).append(i)
    out: list = [None] * len(files)
    for head, own in by.items():
        frame, at = _head_of(head)
        for i, x in zip(own, _decoded(frame, [files[i][at:] for i in own]), strict=True):
            out[i] = x
    return out


def _decoded(frame: Frame, scans: list[bytes]) -> np.ndarray:
    """Samples of frames with the same headers, in lock-step: sample by sample, all frames at once."""
    if any(s[-2:] != TAIL for s in scans):
        raise ValueError("a frame breaks off")
    k, n = len(scans), frame.height * frame.width
    bodies = [s[:-2].replace(b"\xff\x00", b"\xff") for s in scans]
    data = np.frombuffer(b"".join(bodies) + bytes(8), np.uint8).astype(np.int64)
    word = (data[:-4] << 32) | (data[1:-3] << 24) | (data[2:-2] << 16) | (data[3:-1] << 8) | data[4:]
    ends = np.cumsum([len(b) for b in bodies]) * 8
    at = np.concatenate([[0], ends])[:-1]
    limit, bits = len(word) - 1, frame.bits
    d = np.empty((n, k), np.int64)
    for i in range(n):
        w = (word[np.minimum(at >> 3, limit)] << (at & 7)) & 0xFFFFFFFFFF
        top = w >> (40 - bits)
        cat, used = frame.category[top], frame.length[top]
        if (cat < 0).any():
            raise ValueError("a code that the table has not")
        more = (w >> (40 - used - cat)) & ((1 << cat) - 1)
        d[i] = np.where(more < ((1 << cat) >> 1), more - (1 << cat) + 1, more)
        at = at + used + cat
    if (at > ends).any():
        raise ValueError("a frame has fewer samples than its header says")
    d = d.T.reshape(k, frame.height, frame.width)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    if frame.predictor == 1:
        return (np.cumsum(d, axis=2) & 255).astype(np.uint8)
    d[:, 0, :] = np.cumsum(d[:, 0, :], axis=1)  # the first row is predicted from the left whatever the predictor
    d &= 255
    for y in range(1, frame.height):
        for x in range(1, frame.width):
            a, b, c = d[:, y, x - 1], d[:, y - 1, x], d[:, y - 1, x - 1]
            p = (None, None, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[frame.predictor]
            d[:, y, x] = (d[:, y, x] + p) & 255
    return d.astype(np.uint8)


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def write_avi(frames: list[bytes]) -> bytes:
    """One video stream MJPG at FPS, with an index."""
    k, most = len(frames), max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, k, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, k, most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    movi, index, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        movi.append(c)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    body = b"AVI " + hdrl + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def read_avi(media: bytes) -> tuple[int, list[bytes]]:
    """Frame time in microseconds and the frames in the order of idx1. Raises ValueError on a broken file."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI " or struct.unpack_from("<I", media, 4)[0] + 8 > len(media):
        raise ValueError("no AVI file")
    at, movi, index, tick = 12, None, None, 0
    while at + 8 <= len(media):
        tag, n = struct.unpack_from("<4sI", media, at)
        if at + 8 + n > len(media):
            raise ValueError("a chunk passes the end of the file")
        if tag == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
            tick = struct.unpack_from("<I", media, at + 20)[0]
        elif tag == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif tag == b"idx1":
            index = (at + 8, n)
        at += 8 + n + (n & 1)
    if movi is None or index is None:
        raise ValueError("no movi list or no index")
    frames = []
    for tag, _, off, n in struct.iter_unpack("<4sIII", media[index[0] : index[0] + index[1] // 16 * 16]):
        if tag[2:] in (b"dc", b"db"):
            at = movi + off
            if media[at : at + 8] != struct.pack("<4sI", tag, n):
                raise ValueError("the index and the frames differ")
            frames.append(media[at + 8 : at + 8 + n])
    return tick, frames


def histograms(samples: np.ndarray) -> np.ndarray:
    """Shares of BINS brightness bins, by frame."""
    k = len(samples)
    bins = samples.reshape(k, -1).astype(np.int64) * BINS // 256 + np.arange(k)[:, None] * BINS
    return np.bincount(bins.ravel(), minlength=k * BINS).reshape(k, BINS) / (samples.size / max(k, 1))


def cuts(h: np.ndarray) -> list[int]:
    """First frames of the shots after the first, from the histograms of one video.

    The difference of two neighbours is half the L1 distance. Frame i + 1 begins a shot where its
    difference is a local maximum, at least LEAST, and above mean + FACTOR * deviation of the others
    within REACH frames.
    """
    d = np.abs(np.diff(h, axis=0)).sum(axis=1) / 2
    n = len(d)
    if not n:
        return []
    s, q = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    i = np.arange(n)
    lo, hi = np.maximum(0, i - REACH), np.minimum(n, i + REACH + 1)
    m = np.maximum(hi - lo - 1, 1)
    mean = (s[hi] - s[lo] - d) / m
    dev = np.sqrt(np.maximum((q[hi] - q[lo] - d * d) / m - mean * mean, 0))
    left, right = np.concatenate([[-1], d[:-1]]), np.concatenate([d[1:], [-1]])
    return (np.flatnonzero((d >= LEAST) & (d > mean + FACTOR * dev) & (d > left) & (d >= right)) + 1).tolist()


def clip_rows(samples: np.ndarray, tick: int) -> list[tuple[int, float, float, int, float]]:
    """(clip, start in s, end in s, frames, mean brightness) of the shots of one video."""
    edges = [0, *cuts(histograms(samples)), len(samples)]
    return [(j, a * tick / 1e6, b * tick / 1e6, b - a, float(samples[a:b].mean())) for j, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]


def payload(data: bytes) -> bytes:
    """data filled up with bytes 255 to a positive multiple of FRAME."""
    return data + b"\xff" * (max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


def stored(payloads: list[bytes]) -> list[bytes]:
    """AVI files of payloads; frames are encoded over all of them at once."""
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, SIDE, SIDE)
    files = [f for i in range(0, len(samples), AT_ONCE) for f in encode_frames(samples[i : i + AT_ONCE])]
    out, at = [], 0
    for p in payloads:
        k = len(p) // FRAME
        out.append(write_avi(files[at : at + k]))
        at += k
    return out


def loaded(media: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """Frame time and samples of AVI files; frames are decoded over all of them at once."""
    read = [read_avi(m) for m in media]
    files = [f for _, fs in read for f in fs]
    samples = [x for i in range(0, len(files), AT_ONCE) for x in decode_frames(files[i : i + AT_ONCE])]
    out, at = [], 0
    for tick, fs in read:
        own = samples[at : at + len(fs)]
        if any(x.shape != own[0].shape for x in own):
            raise ValueError("frames of several sizes")
        out.append((tick, np.stack(own) if own else np.empty((0, SIDE, SIDE), np.uint8)))
        at += len(fs)
    return out


def videos(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, media binary): every text as an AVI file."""

    def make(batches):
        for b in batches:
            data = encoded(b.column("text"))
            keys = b.column("key").to_pylist()
            for lo, hi in runs([len(x) + FRAME for x in data]):
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo:hi], pa.int64()), pa.array(stored([payload(x) for x in data[lo:hi]]), pa.binary())], names=[key, "media"])

    return in_arrow(df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")), make, f"{key} long, media binary")


def clips(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, clip, start_s, end_s, frames, brightness): a row for each shot of each file in `media`; null media has none."""

    def make(batches):
        for b in batches:
            keys, files = b.column(key).to_pylist(), b.column("media").to_pylist()
            have = [(k, f) for k, f in zip(keys, files, strict=True) if f is not None]
            for lo, hi in runs([len(f) for _, f in have]):
                rows = [(k, *r) for (k, _), (tick, s) in zip(have[lo:hi], loaded([f for _, f in have[lo:hi]]), strict=True) for r in clip_rows(s, tick)]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64()), strict=True)], names=[key, "clip", "start_s", "end_s", "frames", "brightness"])

    return in_arrow(media.select(key, "media"), make, f"{key} long, clip int, start_s double, end_s double, frames int, brightness double")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_clips int"


def digest(df: DataFrame) -> DataFrame:
    """One row a document: what was stored, what was read back from the stored bytes, and the clips as text."""

    def make(batches):
        for b in batches:
            data, ids = encoded(b.column("text")), b.column("doc_id").to_pylist()
            for lo, hi in runs([len(x) + FRAME for x in data]):
                media = stored([payload(x) for x in data[lo:hi]])
                rows = []
                for doc, x, m, (tick, s) in zip(ids[lo:hi], data[lo:hi], media, loaded(media), strict=True):
                    back = s.tobytes()
                    found = clip_rows(s, tick)
                    said = ";".join(f"{c}:{a:.2f}-{e:.2f}:{n}:{v:.2f}" for c, a, e, n, v in found)
                    rows.append((doc, len(x), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(m), hashlib.sha256(m).hexdigest(), said, len(found)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in DIGEST.split(", ")])

    return in_arrow(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, DIGEST)
