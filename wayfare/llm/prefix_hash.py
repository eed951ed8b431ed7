"""Document fingerprints from prefix polynomial hashes.

A text of n code points gets two arrays H[i] = sum of (c_j + 1) * base^j for j < i, modulo two primes
below 2^31. H answers whether any two spans are equal in constant time (`PrefixHash.span`), and a binary
search over span lengths finds the longest common extension of two positions (`lce`). The fingerprint
keeps the hash of the whole text and the hashes of at most MARKS prefixes and suffixes whose lengths are
multiples of a power of two. Marks of two fingerprints meet at the coarser power, so the longest common
prefix and suffix of two texts follow from the fingerprints alone, again by binary search. It also keeps the
prefix hashes at ANCHORS places at most, which the text itself names: those whose next GRAM code points have a
hash with many low zero bits. The spans between neighbouring anchors are compared by content wherever they lie,
so that what is equal between scattered edits counts too. Likeness is the larger share of the two.

Null counts as the empty text. Equal texts have equal fingerprints; likeness of two empty texts is 1.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, mixed, partitions

#: Moduli and bases of the two polynomials.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Most marks in each direction.
MARKS = 32
#: Most anchors, and code points of the gram that makes a place an anchor.
ANCHORS, GRAM = 32, 12

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_inverse = [pow(b, -1, p) for b, p in zip(BASES, PRIMES, strict=True)]


def powers(k: int, n: int) -> np.ndarray:
    """base_k^0 .. base_k^n modulo prime_k; the table doubles as longer texts come."""
    while len(_powers[k]) <= n:
        t = _powers[k]
        step = np.uint64(int(t[-1]) * BASES[k] % PRIMES[k])
        _powers[k] = np.concatenate([t, t * step % np.uint64(PRIMES[k])])
    return _powers[k]


_inverses = [np.ones(1, np.uint64)]


def inverse_powers(n: int) -> np.ndarray:
    """Inverses of base_0^0 .. base_0^n modulo prime_0."""
    p = np.uint64(PRIMES[0])
    while len(_inverses[0]) <= n:
        t = _inverses[0]
        _inverses[0] = np.concatenate([t, t * np.uint64(int(t[-1]) * _inverse[0] % PRIMES[0]) % p])
    return _inverses[0]


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(c)
        self.h = []
        for k, p in enumerate(PRIMES):
            h = np.zeros(self.n + 1, np.uint64)
            np.cumsum(c * powers(k, self.n)[: self.n] % np.uint64(p), out=h[1:])
            self.h.append(h % np.uint64(p))

    def span(self, i: int, j: int) -> int:
        """62 bits that depend only on the code points of [i, j)."""
        out = 0
        for k, p in enumerate(PRIMES):
            d = (int(self.h[k][j]) - int(self.h[k][i])) % p
            out = out << 31 | d * pow(_inverse[k], i, p) % p
        return out

    def lce(self, other: PrefixHash, i: int, j: int) -> int:
        """Length of the longest common extension of position i here and j there."""
        lo, hi = 0, min(self.n - i, other.n - j)
        while lo < hi:
            m = (lo + hi + 1) // 2
            if self.span(i, i + m) == other.span(j, j + m):
                lo = m
            else:
                hi = m - 1
        return lo

    def anchors(self) -> tuple[int, list[tuple[int, int, int, int]]]:
        """Level from which all anchors are kept, and (place, level, both prefix hashes) of the anchors, in order; a level is a number of low zero bits."""
        if self.n < GRAM:
            return 0, []
        h, p = self.h[0], np.uint64(PRIMES[0])
        m = self.n - GRAM + 1
        gram = (h[GRAM:] + p - h[:m]) % p * inverse_powers(m)[:m] % p
        bits = mixed(gram)
        bits &= ~bits + np.uint64(1)  # the lowest bit that is set
        least = max(0, (self.n // ANCHORS).bit_length() - 1)
        at = np.flatnonzero(bits >= np.uint64(1 << least))
        while len(at) > ANCHORS:
            least += 1
            at = at[bits[at] >= np.uint64(1 << least)]
        return least, [(int(i), int(bits[i]).bit_length() - 1, int(self.h[0][i]), int(self.h[1][i])) for i in at if i]

    @cached_property
    def _own(self) -> Fingerprint:
        e = max(0, (self.n // MARKS).bit_length() if self.n > MARKS else 0)
        lengths = [m << e for m in range(1, (self.n >> e) + 1)]
        marks = [self.span(0, m) & 0xFFFFFFFF for m in lengths], [self.span(self.n - m, self.n) & 0xFFFFFFFF for m in lengths]
        return Fingerprint(self.n, e, self.span(0, self.n), *marks, *self.anchors())

    def fingerprint(self) -> Fingerprint:
        return self._own


class Fingerprint(NamedTuple):
    """Code points, power of the marks, whole hash, prefix marks, suffix marks, least level of the anchors, anchors."""

    n: int
    e: int
    whole: int
    head: list[int]
    tail: list[int]
    coarse: int
    anchors: list[tuple[int, int, int, int]]

    def spans(self, level: int) -> Counter:
        """Lengths of the spans between neighbouring anchors of this level at least, by length and content."""
        whole = (self.whole >> 31, self.whole & 0x7FFFFFFF)
        cuts = [(0, 0, 0, 0), *(a for a in self.anchors if a[1] >= level), (self.n, 0, *whole)]
        out: Counter = Counter()
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b[0] > a[0]:
                out[(b[0] - a[0], *((b[2 + k] - a[2 + k]) * pow(_inverse[k], a[0], p) % p for k, p in enumerate(PRIMES)))] += b[0] - a[0]
        return out



def written(f: Fingerprint) -> str:
    anchors = "".join(f"{at:x}:{level:x}:{h:x}:{g:x};" for at, level, h, g in f.anchors)
    return f"{f.n:x}.{f.e:x}.{f.whole:016x}.{''.join(f'{x:08x}' for x in f.head)}.{''.join(f'{x:08x}' for x in f.tail)}.{f.coarse:x}.{anchors}"


def parsed(s: str) -> Fingerprint:
    n, e, whole, head, tail, coarse, anchors = s.split(".")
    marks = lambda x: [int(x[i : i + 8], 16) for i in range(0, len(x), 8)]
    return Fingerprint(int(n, 16), int(e, 16), int(whole, 16), marks(head), marks(tail), int(coarse, 16), [tuple(int(v, 16) for v in a.split(":")) for a in anchors.split(";")[:-1]])


def _common(a: list[int], ea: int, b: list[int], eb: int) -> int:
    """The longest length, of those marked in both, up to which the marks agree."""
    e = max(ea, eb)
    lo, hi = 0, min(len(a) >> (e - ea), len(b) >> (e - eb))
    while lo < hi:
        m = (lo + hi + 1) // 2
        if a[(m << (e - ea)) - 1] == b[(m << (e - eb)) - 1]:
            lo = m
        else:
            hi = m - 1
    return lo << e


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """0 to 1, 1 for equal texts: the share of the longer text that a common prefix and suffix cover by the marks, or that spans between anchors do which both texts hold.

    The spans are those of the coarser fingerprint's anchors; one that a text holds twice counts as often as the other has it.
    """
    if a.n == b.n and a.whole == b.whole:
        return 1.0
    if not a.n or not b.n:
        return 0.0
    both = _common(a.head, a.e, b.head, b.e) + _common(a.tail, a.e, b.tail, b.e)
    level = max(a.coarse, b.coarse)
    shared = sum((a.spans(level) & b.spans(level)).values())
    return min(max(both, shared), a.n, b.n) / max(a.n, b.n)


def fingerprints(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds `fingerprint` to each row; other columns stay."""

    @F.pandas_udf("string")
    def of(s):
        return s.map(lambda x: written(PrefixHash(x or "").fingerprint()))

    return df.withColumn("fingerprint", of(F.col(column)))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches):
    """Rows come by bucket, its own rows first, in the order of the table; `tail` rows are the first of the next bucket."""
    out: list[tuple] = []
    held, first, bucket = None, None, None  # (doc_id, text, hash object), of the current bucket

    def emit(row, following):
        doc, text, h = row
        n, k = h.n, h.n // 3
        edited = text[: n - k] + following[1][:k]
        f, g = h.fingerprint(), PrefixHash(edited).fingerprint()
        out.append((doc, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(f), written(g), likeness(f, g), likeness(f, following[2].fingerprint())))

    def flush():
        cols = list(zip(*out, strict=True)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        out.clear()
        return b

    for batch in batches:
        for doc, text, b, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "tail")), strict=True):
            if b != bucket:
                if held is not None:  # no tail came: the table ends here and has one bucket
                    emit(held, first)
                held, first, bucket = None, None, b
            if tail and held is None:
                continue
            row = (doc, text or "", PrefixHash(text or ""))
            if held is not None:
                emit(held, row)
            first = first or row
            held = None if tail else row
        if len(out) >= 500:
            yield flush()
    if held is not None:
        emit(held, first)
    yield flush()


def edited_likeness(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """For each document its fingerprint, that of its edited text, and their likeness.

    The edited text has the last third of the code points replaced by as many (or all) from the start of
    the next document in descending doc_id; after the last comes the first. Rows of one doc_id follow each
    other by text; a null doc_id comes last. The table is dealt by ranges of doc_id whose bounds are ids
    of the table, and the row at each bound goes to the range before it too, so that no range needs
    another and nothing is gathered: one shuffle of the texts, sorted inside each range.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = parts or partitions(spark)
    at = [i / parts for i in range(1, parts)] or [0.5]
    top, bounds = docs.agg(F.max("doc_id"), F.percentile_approx("doc_id", at, 100 * parts)).first()
    bounds = sorted(set(bounds or []) - {top})
    last = len(bounds)
    ids = F.array(*(F.lit(x).cast("long") for x in bounds)) if bounds else F.array().cast("array<long>")
    bucket = F.coalesce(F.size(F.filter(ids, lambda q: q >= F.col("doc_id"))), F.lit(last)).cast("int")
    # a null doc_id makes the filter empty, but belongs behind all others
    bucket = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(bucket)
    to = F.array_compact(
        F.array(
            F.struct(bucket.alias("bucket"), F.lit(0).alias("tail")),
            F.when(F.array_contains(ids, F.col("doc_id")), F.struct((bucket - 1).alias("bucket"), F.lit(1).alias("tail"))),
            F.when(F.col("doc_id") == F.lit(top).cast("long"), F.struct(F.lit(last).alias("bucket"), F.lit(1).alias("tail"))),
        )
    )
    dealt = docs.select("doc_id", "text", F.inline(to)).repartitionById(last + 1, "bucket")
    dealt = dealt.sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return in_arrow(dealt, _pairs, SCHEMA)
