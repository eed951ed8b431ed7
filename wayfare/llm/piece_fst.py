"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into three transducers: the normaliser (dummy prefix, white space to U+2581,
optional removal of extra white space), the pieces with their scores as arc weights, and the byte
fallback for characters that no piece holds. An input is composed with them into a lattice whose states
are the positions of the normalised text, and the tropical-semiring shortest path through it is the
encoding.

For a unigram model that is the path of the largest total score. For a BPE model the pieces are composed
with one more acceptor, over neighbouring pieces: the arc of a pair weighs 0 if merging its joined text
gives the pair again, and is infinite if not; likewise a piece that merging its own characters would not
give. Exactly one path to each position is finite, the one that merging would give, so the shortest path
is the BPE encoding. Merges are run only on single pairs, to weigh their arcs.

The lattice has a single state before each run of U+2581 after other text, where no piece goes on, so
paths are found for the stretches between such states and kept in a bounded table of a worker.

Decoding composes piece ids with the inverse: bytes of pieces and of fallback bytes, joined, read as
UTF-8 (a broken sequence gives U+FFFD), the dummy prefix removed. So decode(encode(x)) is the normalised x
with U+2581 as blanks. Null text gives no ids, as the empty text does.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, in_arrow, runs, texts

#: Where the model file lies by default; a parameter everywhere.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Entries of a worker's tables; a full one becomes the older one, which gives up what is used again. Longer stretches are not kept.
KEPT, PAIRS, KEPT_LENGTH = 450_000, 400_000, 24

# Piece types and field numbers of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
INFINITE = float("inf")


def fields(b: bytes):
    """(field, value) pairs of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        v = s = 0
        while True:
            c = b[i]
            i += 1
            v |= (c & 127) << s
            s += 7
            if c < 128:
                return v, i

    i = 0
    while i < len(b):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = b[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = struct.unpack("<d" if n == 8 else "<f", b[i : i + n])[0], i + n
        yield tag >> 3, value


class Transducer:
    """A compiled model."""

    def __init__(self, data: bytes, kept: int = KEPT, pairs: int = PAIRS):
        self.most_kept, self.most_pairs = kept, pairs
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.dummy, self.squeeze, self.escape, name, charsmap = UNIGRAM, True, True, True, "", b""
        for f, v in fields(data):
            if f == 1:
                x = dict(fields(v))
                self.pieces.append((x.get(1, b"").decode(), x.get(2, 0.0), x.get(3, NORMAL)))
            elif f == 2:
                self.kind = dict(fields(v)).get(3, UNIGRAM)
            elif f == 3:
                x = dict(fields(v))
                name, charsmap = x.get(1, b"").decode(), x.get(2, b"")
                self.dummy, self.squeeze, self.escape = (bool(x.get(k, 1)) for k in (3, 4, 5))
        if charsmap or name not in ("", "identity"):
            raise ValueError(f"normaliser {name!r} with a character map is not supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER)}
        self.score = {p: self.pieces[i][1] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.reach: dict[str, int] = {}  # last three characters: the longest piece that ends so
        for p in self.ids:
            if len(p) >= 3:
                self.reach[p[-3:]] = max(len(p), self.reach.get(p[-3:], 3))
        self.unknown = next((i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN), 0)
        fallback = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.fallback = fallback if len(fallback) == 256 else None
        self.low = min(self.score.values(), default=0.0) - 10.0  # weight of a character that no piece holds
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            self.stretch = re.compile(r".+", re.S)
        elif any("\n" in p for p in self.ids):
            self.stretch = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        else:
            self.stretch = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
        self.output = [self._bytes(p, t) for p, _, t in self.pieces]
        self.pairs: dict[tuple[str, str], float] = {}
        self.old_pairs: dict[tuple[str, str], float] = {}
        #: The pieces whose own arc is finite, found when the model is compiled.
        self.finite = {p for p in self.ids if self.own_weight(p) < INFINITE}
        self.kept: dict[str, bytes] = {}
        self.old_kept: dict[str, bytes] = {}

    def _bytes(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind in (CONTROL, UNUSED):
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.replace(MARK, " ")).strip(" ")
        if self.dummy and text:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text

    def merged(self, s: str) -> list[str]:
        """What merging gives: the neighbours whose joined text scores highest, leftmost first, until none is a piece."""
        parts, score, none = list(s), self.score.get, float("-inf")
        scores = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            best = max(scores)
            if best == none:
                break
            at = scores.index(best)
            parts[at] += parts.pop(at + 1)
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def weight(self, a: str, b: str) -> float:
        """Weight of the acceptor's arc from piece a to piece b, 0 or infinite; for pairs that are not in the newer table."""
        w = self.old_pairs.get((a, b))
        if w is None:
            w = 0.0 if self.merged(a + b) == [a, b] else INFINITE
        if len(self.pairs) >= self.most_pairs:
            self.old_pairs, self.pairs = self.pairs, {}
        self.pairs[a, b] = w
        return w

    def own_weight(self, piece: str) -> float:
        """Weight of the arc of one piece: its negative score in a unigram model; in a BPE model 0, or infinite where merging its characters does not give it."""
        if self.kind != BPE:
            return -self.score[piece]
        return 0.0 if len(piece) == 1 or self.merged(piece) == [piece] else INFINITE

    def path(self, s: str) -> list[str]:
        """Arc inputs of the tropical shortest path through the composition of one stretch with pieces and acceptor."""
        return self._accepted(s) if self.kind == BPE else self._lightest(s)

    def _lightest(self, s: str) -> list[str]:
        """A unigram model: a state of the composition is a position, and the path is least in the sum of its weights."""
        n, get = len(s), self.score.get
        cost, last = [0.0] + [INFINITE] * n, [""] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                piece = s[j:i]
                weight = get(piece, self.low if j == i - 1 else None)
                if weight is not None and cost[j] - weight < cost[i]:
                    cost[i], last[i] = cost[j] - weight, piece
        return self._traced(last)

    def _accepted(self, s: str) -> list[str]:
        """A BPE model: a state of the composition is a position and the piece that ends there.

        Of the states of a position exactly one has a finite cost, the encoding of the text up to there. So states of
        infinite cost are not stored, and the search of a position ends with its first arc of finite weight.
        """
        n, finite, reach, pairs = len(s), self.finite, self.reach.get, self.pairs.get
        last = [""] * (n + 1)
        for i in range(1, n + 1):
            far = reach(s[i - 3 : i], 2) if i >= 3 else i
            for j in range(i - far if i > far else 0, i):
                piece = s[j:i]
                if piece in finite:
                    if j:
                        before = last[j]
                        w = pairs((before, piece))
                        if self.weight(before, piece) if w is None else w:
                            continue
                    last[i] = piece
                    break
            else:
                last[i] = s[i - 1]  # no piece ends here: the fallback's arc, or a character that joins nothing
        return self._traced(last)

    @staticmethod
    def _traced(last: list[str]) -> list[str]:
        out, n = [], len(last) - 1
        while n:
            out.append(last[n])
            n -= len(last[n])
        out.reverse()
        return out

    def arcs(self, s: str) -> bytes:
        """Ids of one stretch as little-endian 32-bit integers, where the newer table has none."""
        got = self.old_kept.get(s)
        if got is None:
            ids: list[int] = []
            for p in self.path(s):
                i = self.ids.get(p)
                if i is not None:
                    ids.append(i)
                elif self.fallback is None:
                    if not ids or ids[-1] != self.unknown:
                        ids.append(self.unknown)
                else:
                    ids.extend(self.fallback[b] for b in p.encode("utf-8", "surrogatepass"))
            got = struct.pack(f"<{len(ids)}i", *ids)
        if len(s) <= KEPT_LENGTH:
            if len(self.kept) >= self.most_kept:
                self.old_kept, self.kept = self.kept, {}
            self.kept[s] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        arcs = self.arcs
        return np.frombuffer(b"".join([self.kept.get(s) or arcs(s) for s in self.stretch.findall(self.normalise(text))]), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.output.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return out[1:] if self.dummy and out.startswith(" ") else out


#: Under which a worker holds the transducer and its tables from task to task.
HOLDS = "pieces"


@lru_cache(maxsize=1)
def compiled(model: bytes, kept: int = KEPT, pairs: int = PAIRS) -> Transducer:
    hold(HOLDS, compiled.cache_clear)
    return Transducer(model, kept, pairs)


def encode(docs: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",), kept: int = KEPT, pairs: int = PAIRS) -> DataFrame:
    """The columns `keep` with ids array<int>, n_pieces, and round_trip: whether decoding gives the normalised text again.

    The model file is read by the driver and sent with the tasks. kept and pairs bound the tables of a worker, which
    outlive a task but not the operator: they trade its memory for time and change no result. A column of `keep` named
    like one of the three gives way to it. Repeated rows stay, each with its ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(open(model, "rb").read())  # the file's own size
    keep = tuple(c for c in keep if c.lower() not in ("ids", "n_pieces", "round_trip"))

    def make(batches):
        t = compiled(shared.value, kept, pairs)
        for b in batches:
            parts = texts(b.column("text"))
            for lo, hi in runs([len(x) + 1 for x in parts]):
                found = [t.encode(x) for x in parts[lo:hi]]
                same = [t.decode(i) == (x if not t.squeeze else t.normalise(x).replace(MARK, " ").removeprefix(" ")).replace(MARK, " ") for i, x in zip(found, parts[lo:hi], strict=True)]
                sizes = [len(i) for i in found]
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(found).astype(np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in keep), ids, pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())], names=[*keep, "ids", "n_pieces", "round_trip"])

    need = docs.select(*(F.col(f"`{c}`") for c in [*keep, *(["text"] if "text" not in keep else [])]))
    names = ", ".join(f"`{c}` {need.schema[c].dataType.simpleString()}" for c in keep)
    return in_arrow(need, make, f"{names}{', ' if keep else ''}ids array<int>, n_pieces long, round_trip boolean", HOLDS)


def decode(encoded: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with the text of `ids`; null ids give null. A column of `keep` named text gives way to it."""
    shared = encoded.sparkSession.sparkContext.broadcast(open(model, "rb").read())
    keep = tuple(c for c in keep if c.lower() != "text")

    def make(batches):
        t = compiled(shared.value)
        for b in batches:
            out = [None if x is None else t.decode(np.asarray(x, np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, "text"])

    names = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)
    return in_arrow(encoded.select(*(F.col(f"`{c}`") for c in keep), "ids"), make, f"{names}{', ' if keep else ''}text string", HOLDS)
