"""Removal of repeated byte strings by a distributed difference-cover suffix array.

A byte goes when it is covered by a string of SPAN bytes that also starts earlier in the table. The work
runs in steps, all exact:

1. Dealing. Every string of SPAN bytes holds a gram of GRAM bytes with the least hash, and equal strings
   hold it at the same place. Each document lists these anchors with their surroundings, the context: all
   strings that hold the anchor's gram, at most SPAN + SPAN - GRAM bytes. Anchors are dealt by the gram's
   hash, so all strings that are equal meet.
2. Equal contexts. In a group of equal grams, a context that has been seen before is repeated as a whole;
   only its first occurrence goes on, and only where the group has contexts that differ. Rows are sorted,
   so a group of any size is read as a stream; equal contexts of one batch travel as one row.
3. Suffix array. The contexts that are left are fetched and sorted by the difference cover modulo 3: the
   triples at positions 1 and 2 modulo 3 are sorted and named, the names are sorted by recursion, the
   other suffixes follow from them, and both are merged. Neighbours in the array whose first SPAN bytes
   agree are one class; all of a class but the earliest are repeated. A gram that is so frequent that more
   than HOT different contexts hold it would make one task's group as large as the table. Its strings are
   dealt anew, each by two 64-bit hashes of its own bytes, and read as sorted streams.
4. The spans of each document are united and cut out.

Contexts that are equal as a whole, and strings of hot grams, are told apart by hashes of 64 and 128 bits; all
other strings by their bytes. Null text is empty, an empty table gives an empty result. Rows of one doc_id follow each other by a hash of the text; a null doc_id comes last.
Documents below SPAN bytes keep all their bytes. A text holds at most 2^31 bytes, as Arrow does.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, encoded, in_arrow, mixed, partitions, runs, wrapping_powers

#: Bytes of a repeated string, of a gram, and grams of a string.
SPAN, GRAM = 100, 28
WINDOW = SPAN - GRAM + 1
#: Positions share a word with a hash: bits of a position inside a piece of a long text.
BITS = 22
#: Symbols that are sorted at once, and contexts of one gram up to which they are.
AT_ONCE, HOT = 1 << 19, 2500
LAST = (1 << 63) - 1

_symbol = mixed(np.arange(1, 257, dtype=np.uint64))


def prefix_hashes(b: np.ndarray) -> np.ndarray:
    h = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_symbol[b] * wrapping_powers(len(b))[: len(b)], out=h[1:])
    return h


def least_positions(g: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leftmost least value of each window: its position, and the first and the last window that it rules."""
    found, starts, step = [], [], (1 << BITS) - width
    low = np.uint64((1 << BITS) - 1)
    count = len(g) - width + 1
    for s in range(0, count, step):
        x = g[s : min(s + step, count) + width - 1]
        x = (x & ~low) | np.arange(len(x), dtype=np.uint64)
        n = len(x)
        full = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        full[:n] = x
        rows = full.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = (np.minimum(back[: n - width + 1], ahead[width - 1 : n]) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        found.append(least[first] + s)
        starts.append(first + s)
    at, first = np.concatenate(found), np.concatenate(starts)
    fresh = np.concatenate([[True], at[1:] != at[:-1]])  # a piece may go on with the position before it
    at, first = at[fresh], first[fresh]
    return at, first, np.append(first[1:], count) - 1


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, context hash and packed place (position, bytes before, bytes after) of each anchor.

    The context is what the strings cover whose least gram the anchor is: at least SPAN bytes.
    """
    b = np.frombuffer(text, np.uint8)
    n = len(b)
    if n < SPAN:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    h, back = prefix_hashes(b), wrapping_powers(n, True)
    g = mixed((h[GRAM:] - h[:-GRAM]) * back[: n - GRAM + 1])
    at, first, last = least_positions(g, WINDOW)
    before, after = at - first, last + SPAN - at
    c = mixed((h[last + SPAN] - h[first]) * back[first] + (before * 256 + after).astype(np.uint64))
    return g[at], c, at << 16 | before << 8 | after


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


LISTED = "h long, c long, doc long, dup int, at long, more binary"
DECIDED = "doc long, dup int, lo int, hi int, h long"


def _listed(batches):
    """Anchors of a batch of documents, equal (h, c) as one row with the later ones packed in `more`."""
    for b in batches:
        data = encoded(b.column("text"))
        docs, dups = b.column("doc").to_numpy(zero_copy_only=False), b.column("dup").to_numpy(zero_copy_only=False)
        for lo, hi in runs([len(x) for x in data]):
            found = [anchors(x) for x in data[lo:hi]]
            h, c, at = (np.concatenate([f[i] for f in found]) for i in range(3))
            owner = np.repeat(np.arange(lo, hi), [len(f[2]) for f in found])
            doc, dup = docs[owner], dups[owner]
            order = np.lexsort((at, dup, doc, c, h))
            h, c, doc, dup, at = h[order], c[order], doc[order], dup[order], at[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            starts = np.flatnonzero(first)
            ends = np.append(starts[1:], len(h))
            more: list[bytes | None] = [None] * len(starts)
            packed = np.stack([doc, dup.astype(np.int64), at], axis=1) if len(h) else np.empty((0, 3), np.int64)
            for k in np.flatnonzero(ends - starts > 1):
                more[k] = packed[starts[k] + 1 : ends[k]].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(_signed(h[starts])), pa.array(_signed(c[starts])), pa.array(doc[starts]), pa.array(dup[starts].astype(np.int32)), pa.array(at[starts]), pa.array(more, pa.binary())], names=["h", "c", "doc", "dup", "at", "more"])


def _rows(doc, dup, lo, hi, h=None):
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(np.asarray(dup, np.int32)), pa.array(np.asarray(lo, np.int32)), pa.array(np.asarray(hi, np.int32)), pa.nulls(n, pa.int64()) if h is None else pa.array(h, pa.int64())], names=["doc", "dup", "lo", "hi", "h"])


def _repeated(doc, dup, at):
    """Spans of contexts that are repeated as a whole."""
    lo, hi = (at >> 16) - ((at >> 8) & 255), (at >> 16) + (at & 255)
    return _rows(doc, dup, lo, hi)


def _decided(batches):
    """Rows sorted by h, c, doc, dup, at. Gives spans of repeated contexts (h null), and the first of each context where a group has several."""
    last_h = last_c = None
    held, several = None, False  # the single first context of the open group; whether the group has shown several
    for b in batches:
        h, c, doc, dup, at = (b.column(k).to_numpy(zero_copy_only=False) for k in ("h", "c", "doc", "dup", "at"))
        if not len(h):
            continue
        extra = [np.frombuffer(x, np.int64).reshape(-1, 3) for x in b.column("more").drop_null().to_pylist()]
        if extra:
            m = np.concatenate(extra)
            yield _repeated(m[:, 0], m[:, 1], m[:, 2])
        new_h, new_c = np.ones(len(h), bool), np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new_c[1:] = new_h[1:] | (c[1:] != c[:-1])
        new_h[0] = last_h is None or h[0] != last_h
        new_c[0] = new_h[0] or c[0] != last_c
        if (~new_c).any():
            yield _repeated(doc[~new_c], dup[~new_c], at[~new_c])
        group = np.cumsum(new_h)  # 0: the group that the batch before left open
        f = np.flatnonzero(new_c)
        count = np.bincount(group[f], minlength=group[-1] + 1)
        if new_h[0]:
            held, several = None, False
        else:
            count[0] += 1 if held is not None or several else 0
        ask = f[(count[group[f]] >= 2) | ((group[f] == 0) & several)]
        if held is not None and count[0] >= 2 and not new_h[0]:
            yield _rows(*([x] for x in held[:4]), h=[held[4]])
            held, several = None, True
        if len(ask):
            yield _rows(doc[ask], dup[ask], at[ask] >> 16, at[ask] & 65535, h[ask])
        if group[-1] > 0:
            tail = f[group[f] == group[-1]]
            several = len(tail) >= 2
            held = None if several else (doc[tail[0]], dup[tail[0]], at[tail[0]] >> 16, at[tail[0]] & 65535, h[tail[0]])
        last_h, last_c = h[-1], c[-1]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of s, whole numbers above 0, in order, by the difference cover modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(3, np.int64)])
    top = int(t.max()) + 1
    i12 = np.arange(n + (n % 3 == 1))
    i12 = i12[i12 % 3 != 0]

    def pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
        """One number for each pair, in their order, and a bound."""
        if top < 1 << 20:
            return a * top + b, top * top
        names, where = np.unique(a * top + b, return_inverse=True)
        return where, len(names) + 1

    # sort the sampled triples and name them
    first, _ = pairs(t[i12], t[i12 + 1])
    key = first * top + t[i12 + 2]
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(fresh)
    del first, key
    if not fresh.all():  # recurse on the names
        one = i12 % 3 == 1
        place = np.concatenate([i12[one], i12[~one]])
        sa12 = place[suffix_array(np.concatenate([names[one], names[~one]]))]
    else:
        sa12 = i12[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sa12] = np.arange(1, len(sa12) + 1)
    sa12 = sa12[sa12 < n]
    bound = len(rank) + 2
    # the other suffixes by first symbol and the rank behind it
    i0 = np.arange(0, n, 3)
    key0 = t[i0] * bound + rank[i0 + 1]
    by0 = np.argsort(key0, kind="stable")
    sa0, key0 = i0[by0], key0[by0]
    # merge: for each of them, how many sampled suffixes are smaller
    j1, j2 = sa12[sa12 % 3 == 1], sa12[sa12 % 3 == 2]
    c1 = np.searchsorted(t[j1] * bound + rank[j1 + 1], key0)
    both, _ = pairs(np.concatenate([t[sa0], t[j2]]), np.concatenate([t[sa0 + 1], t[j2 + 1]]))
    c2 = np.searchsorted(both[len(sa0) :] * bound + rank[j2 + 2], both[: len(sa0)] * bound + rank[sa0 + 2])
    out = np.empty(n, np.int64)
    spot = np.arange(len(sa0)) + c1 + c2
    rest = np.ones(n, bool)
    rest[spot] = False
    out[spot] = sa0
    out[rest] = sa12
    return out


def repeated_starts(contexts: list[bytes], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of every string of SPAN bytes that is not the earliest of its class.

    order: (contexts, 2) whole numbers, the rank of the document and the start of the context in it.
    """
    size = np.array([len(x) for x in contexts])
    base = np.cumsum(size + 1) - size - 1
    s = np.frombuffer(b"\x00".join(contexts) + b"\x00", np.uint8)
    wide = s.astype(np.int64) + len(contexts) + 1
    wide[base + size] = np.arange(1, len(contexts) + 1)  # every context ends in a symbol of its own
    array = suffix_array(wide)
    owner = np.repeat(np.arange(len(contexts)), size + 1)
    offset = np.arange(len(s)) - base[owner]
    array = array[offset[array] + SPAN <= size[owner[array]]]
    if not len(array):
        return array, array
    windows = sliding_window_view(s, SPAN)
    same = np.zeros(len(array), bool)
    for lo in range(0, len(array) - 1, 1 << 16):
        a = windows[array[lo : lo + (1 << 16) + 1]]
        same[lo + 1 : lo + len(a)] = (a[1:] == a[:-1]).all(axis=1)
    key = (order[owner[array], 0] << 32) + order[owner[array], 1] + offset[array]
    starts = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(key, starts), np.diff(np.append(starts, len(array))))
    hit = np.sort(array[key > least])
    return owner[hit], offset[hit]


def _sorted_out(batches):
    """Contexts sorted by h, at most HOT of one h; groups are packed to about AT_ONCE symbols."""
    held: list[tuple] = []

    def solve(rows):
        doc, dup, lo = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        by = np.lexsort((dup, doc))
        fresh = np.ones(len(by), np.int64)
        fresh[1:] = (doc[by][1:] != doc[by][:-1]) | (dup[by][1:] != dup[by][:-1])
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(fresh)
        contexts, spots = [r[4] for r in rows], np.stack([rank, lo], axis=1)
        who, off = repeated_starts(contexts, spots)
        if not len(who):
            return None
        edge = np.ones(len(who), bool)
        edge[1:] = (who[1:] != who[:-1]) | (off[1:] != off[:-1] + 1)
        a = np.flatnonzero(edge)
        z = np.append(a[1:], len(who)) - 1
        w = who[a]
        return _rows(doc[w], dup[w], lo[w] + off[a], lo[w] + off[z] + SPAN)

    size = begin = 0  # symbols held, and where the last group begins in `held`
    own = 0  # symbols of the last group
    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in ("h", "doc", "dup", "lo", "bytes")), strict=True):
            if held and held[-1][0] != row[0]:
                if size >= AT_ONCE:
                    ready = [held[:begin], held[begin:]] if own > AT_ONCE // 2 else [held]
                    for part in ready:
                        if part and (out := solve(part)) is not None:
                            yield out
                    held, size = [], 0
                begin, own = len(held), 0
            held.append(row)
            size += len(row[4]) + 1
            own += len(row[4]) + 1
    for part in ([held[:begin], held[begin:]] if own > AT_ONCE // 2 else [held]):
        if part and (out := solve(part)) is not None:
            yield out


FETCHED = "h long, doc long, dup int, lo int, bytes binary, gram int, hot boolean"


def _fetched(batches):
    for b in batches:
        data = encoded(b.column("text"))
        rows = []
        for text, doc, dup, asked in zip(data, b.column("doc").to_pylist(), b.column("dup").to_pylist(), b.column("asked").to_pylist(), strict=True):
            for x in asked:
                at, before, after = x["lo"], x["hi"] >> 8, x["hi"] & 255
                rows.append((x["h"], doc, dup, at - before, text[at - before : at + after], before, x["hot"]))
        for i in range(0, len(rows), 20_000):
            part = list(zip(*rows[i : i + 20_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.bool_()), strict=True)], names=[c.split()[0] for c in FETCHED.split(", ")])


STRINGS = "a long, b long, doc long, dup int, lo int"


def _strings(batches):
    """Every string of SPAN bytes of a hot gram's contexts by two hashes of its bytes and of its place around the gram."""
    for batch in batches:
        docs, dups, los, grams = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc", "dup", "lo", "gram"))
        contexts = batch.column("bytes").to_pylist()
        for i in range(0, len(contexts), 2000):
            part = contexts[i : i + 2000]
            size = np.array([len(x) for x in part])
            base = np.cumsum(size) - size
            s = np.frombuffer(b"".join(part), np.uint8)
            count = size - SPAN + 1
            own = np.repeat(np.arange(len(part)), count)
            off = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            at = base[own] + off
            place = (grams[i : i + 2000][own] - off).astype(np.uint64)
            keys = []
            for symbols, salt in ((s, np.uint64(1)), (s ^ np.uint8(0xA7), np.uint64(3))):  # another numbering of the bytes for the second
                h = prefix_hashes(symbols)
                keys.append(_signed(mixed((h[at + SPAN] - h[at]) * wrapping_powers(len(s), True)[at] + place * salt)))
            yield pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(docs[i : i + 2000][own]), pa.array(dups[i : i + 2000][own].astype(np.int32)), pa.array((los[i : i + 2000][own] + off).astype(np.int32))], names=["a", "b", "doc", "dup", "lo"])


def _later(batches):
    """Strings sorted by both hashes, doc, dup, lo: spans of all but the first of each. Read as a stream, so a string may be as frequent as it likes."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, doc, dup, lo = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("a", "b", "doc", "dup", "lo"))
        same = np.zeros(len(a), bool)
        same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        same[0] = last == (a[0], b[0])
        last = a[-1], b[-1]
        yield _rows(doc[same], dup[same], lo[same], lo[same] + SPAN)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans; touching spans are one run."""
    out: list[tuple[int, int]] = []
    for lo, hi in spans:
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _united(batches):
    """Packed spans of each document, united."""
    for b in batches:
        out = [np.array(united(sorted((x["lo"], x["hi"]) for x in spans)), np.int32).tobytes() for spans in b.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("dup"), pa.array(out, pa.binary())], names=["doc", "dup", "packed"])


def _kept(batches):
    for b in batches:
        rows = []
        for text, packed in zip(encoded(b.column("text")), b.column("packed").to_pylist(), strict=True):
            spans = np.frombuffer(packed or b"", np.int32).reshape(-1, 2).tolist()
            at, parts = 0, []
            for lo, hi in spans:
                parts.append(text[at:lo])
                at = hi
            parts.append(text[at:])
            kept = b"".join(parts)
            rows.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    if docs.groupBy("doc").count().where("count > 1").limit(1).count():
        docs = docs.withColumn("dup", F.row_number().over(Window.partitionBy("doc").orderBy(F.xxhash64("text"), "text")).cast("int"))
    else:
        docs = docs.withColumn("dup", F.lit(0))
    parts = partitions(spark)
    listed = in_arrow(docs.select("doc", "dup", "text"), _listed, LISTED)
    listed = listed.repartition(parts, "h").sortWithinPartitions("h", "c", "doc", "dup", "at")
    decided = cut(in_arrow(listed, _decided, DECIDED))
    ask = decided.where("h IS NOT NULL")
    hot = ask.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("h", F.lit(True).alias("hot"))
    ask = ask.join(hot, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    asked = ask.groupBy("doc", "dup").agg(F.collect_list(F.struct("h", "lo", "hi", "hot")).alias("asked"))
    contexts = cut(in_arrow(docs.select("doc", "dup", "text").join(asked, ["doc", "dup"]), _fetched, FETCHED))
    solved = in_arrow(contexts.where("NOT hot").repartition(parts, "h").sortWithinPartitions("h", "doc", "dup", "lo"), _sorted_out, DECIDED)
    strings = in_arrow(contexts.where("hot").select("doc", "dup", "lo", "bytes", "gram"), _strings, STRINGS)
    later = in_arrow(strings.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "doc", "dup", "lo"), _later, DECIDED)
    solved = solved.union(later)
    spans = decided.where("h IS NULL").union(solved).where(f"hi - lo >= {SPAN}")
    per_doc = spans.groupBy("doc", "dup").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    packed = in_arrow(per_doc, _united, "doc long, dup int, packed binary")
    out = docs.join(packed, ["doc", "dup"], "left").select("doc_id", "text", "packed")
    return in_arrow(out, _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
