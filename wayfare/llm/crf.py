"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a probability for each language. A word's score is the sum of learned weights
of its affixes (its first and its last AFFIX letters, hashed apart from one another and from all else), of
its hashed character bigrams and trigrams, in which a blank stands at either end of the word, and of its
membership in each language's lexicon.
Learned transitions couple neighbours; forward-backward gives the marginals. Texts that switch between
languages come out as spans; a document's language is the one with the largest mean marginal.

The model is fitted by maximum likelihood on at most SAMPLE whole documents of each language, chosen by
a hash of id and text, and on all languages: a document after the first is left out where the ones before fill
its language's share of SAMPLE_BYTES. Training chains splice pieces
of different documents, so that switches are seen. Only texts and labels of documents that are not held
out are used. Prediction reads nothing but the text.

A text that is null or has no letter gets `und` with score 0. Without labelled rows all texts do. Every row is
judged by its own text, so repeated rows and repeated ids get equal results, null ids stay, and an empty table gives
an empty result. Ties go to the language that comes first in code point order. Very long texts are judged whole, in
bounded stretches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, in_arrow, mixed, runs, span_hashes, texts, utf8_bytes

#: Labelled documents of each language that the model is fitted on, at most.
SAMPLE = 150
#: Bytes of their text, shared equally by the languages.
SAMPLE_BYTES = 8 << 20
#: Words of a language's lexicon: those seen at least twice there, by frequency.
LEXICON = 4000
#: Buckets of hashed n-grams, and words of a block of the chain.
BUCKETS, BLOCK = 1 << 16, 64
#: Letters of a prefix or suffix.
AFFIX = 4
#: Numbers of an array that a worker holds at once, about, whatever the languages and the length of a text.
CELLS = 1 << 19
STEPS, RATE, DECAY = 40, 0.15, 1e-4
UNKNOWN = "und"

_letter = np.array([chr(i).isalpha() for i in range(0x10000)])


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # (BUCKETS, L)
    affixes: np.ndarray  # (BUCKETS, L)
    lexicon: np.ndarray  # (L, L): weight of a word of lexicon a for language b
    words: np.ndarray  # sorted hashes of all lexicon words
    member: np.ndarray  # (len(words), L) 0 or 1
    move: np.ndarray  # (L, L) log weights of transitions


def letters(c: np.ndarray) -> np.ndarray:
    out = _letter[np.minimum(c, 0xFFFF)]
    for i in np.flatnonzero(c > 0xFFFF):
        out[i] = chr(c[i]).isalpha()
    return out


def split(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of the texts, each with a blank before and after; starts, ends and text of each word."""
    low = [p.lower() for p in parts]
    c = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters(c)
    step = np.diff(is_letter.astype(np.int8))
    starts, ends = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    begin = np.cumsum([1, *(len(p) + 1 for p in low)])
    return np.where(is_letter, c, 0).astype(np.uint32), starts, ends, np.searchsorted(begin, starts, side="right") - 1


def gram_ids(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the bigram and the trigram that end at each position."""
    c = c.astype(np.uint64)
    a, b = np.concatenate([[0], c[:-1]]).astype(np.uint64), np.concatenate([[0, 0], c[:-2]]).astype(np.uint64)
    two = mixed(a * np.uint64(0x110000) + c + np.uint64(1 << 45))
    three = mixed((b * np.uint64(0x110000) + a) * np.uint64(0x110000) + c)
    return (two % np.uint64(BUCKETS)).astype(np.int64), (three % np.uint64(BUCKETS)).astype(np.int64)


def grams_at(c: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What gram_ids gives at some positions alone, for far less memory."""
    own = np.stack([np.where(at > 1, c[np.maximum(at - 2, 0)], 0), np.where(at > 0, c[np.maximum(at - 1, 0)], 0), c[at]], axis=1)
    two, three = gram_ids(own.ravel())
    return two[2::3], three[2::3]


def affix_ids(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the prefix and the suffix of each word: at most AFFIX letters, with their number."""
    out = []
    for salt, at, way in ((1, starts, 1), (2, ends - 1, -1)):
        x = np.full(len(starts), salt, np.uint64)
        for k in range(AFFIX):
            here = k < ends - starts
            letter = np.where(here, c[np.where(here, at + way * k, 0)].astype(np.uint64), np.uint64(0))
            x = mixed(x * np.uint64(0x110000) + letter + np.uint64(1 << 50))
        out.append((x % np.uint64(BUCKETS)).astype(np.int64))
    return out[0], out[1]


def emissions(m: Model, c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(words, L): log weight of each language for each word.

    Symbols are turned into weights window by window, of CELLS weights at most; a word that crosses an edge gets its sum in parts.
    """
    out = np.zeros((len(starts), len(m.languages)))
    if not len(starts):
        return out
    step = max(1024, CELLS // max(1, len(m.languages)))
    lo = int(starts[0]) + 1
    while lo <= ends[-1]:
        hi = min(lo + step, int(ends[-1]) + 1)
        at = max(0, lo - 2)
        two, three = (x[lo - at :] for x in gram_ids(c[at:hi]))
        sums = np.zeros((hi - lo + 1, len(m.languages)))
        np.cumsum(m.grams[two] + m.grams[three], axis=0, out=sums[1:])
        # words of which a position from starts + 1 to ends lies in [lo, hi)
        i, j = np.searchsorted(ends, lo), np.searchsorted(starts, hi - 1)
        a, z = np.clip(starts[i:j] + 1, lo, hi) - lo, np.clip(ends[i:j] + 1, lo, hi) - lo
        out[i:j] += sums[z] - sums[a]
        lo = hi
    before = np.maximum(starts - 1, 0)
    first = gram_ids(np.stack([np.where(starts > 0, c[before], 0), c[starts]], axis=1).ravel())[0][1::2]
    prefix, suffix = affix_ids(c, starts, ends)
    out += m.grams[first]
    out += m.affixes[prefix]
    out += m.affixes[suffix]
    if len(m.words):
        h = span_hashes(c, starts, ends)
        i = np.minimum(np.searchsorted(m.words, h), len(m.words) - 1)
        hit = m.words[i] == h
        out[hit] += m.member[i[hit]] @ m.lexicon
    return out


def marginals(e: np.ndarray, lengths: np.ndarray, move: np.ndarray, messages: list | None = None, ends: tuple[np.ndarray, np.ndarray] | None = None, only_ends: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains laid end to end: e (words, L) log scores, lengths of the chains.

    messages, a list, gets the word weights and the forward and backward messages of every word.
    ends: what comes into each chain from before it and from behind it, where it is a part of a longer one.
    only_ends gives, instead of the marginals, what leaves each chain behind it and before it.

    The chain is cut into blocks of BLOCK words. Each block's product of step matrices is found for all
    blocks at once, messages pass from block to block, and a second pass inside the blocks gives the
    marginals: the same result as one pass over the whole chain.
    """
    size = e.shape[1]
    if not len(e):
        return e
    x = np.exp(e - e.max(axis=1, keepdims=True))
    a = np.exp(move - move.max())
    per = -(-lengths // BLOCK)
    chain = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(per) - per, per)
    count = np.minimum(BLOCK, lengths[chain] - nth * BLOCK)
    first = (np.cumsum(lengths) - lengths)[chain] + nth * BLOCK
    order = np.argsort(-count, kind="stable")
    count, first = count[order], first[order]
    live = [int(np.searchsorted(-count, -t, side="left")) for t in range(BLOCK + 1)]  # blocks longer than t
    norm = lambda v: v / v.sum(axis=-1, keepdims=True)
    blocks = len(count)
    prod = np.tile(np.eye(size), (blocks, 1, 1))
    for t in range(BLOCK):
        k = live[t]
        if not k:
            break
        p = (prod[:k].reshape(-1, size) @ a).reshape(k, size, size) * x[first[:k] + t][:, None, :]
        prod[:k] = p / p.sum(axis=(1, 2), keepdims=True)
    place = np.empty(blocks, np.int64)  # where the blocks of the chains, in order, stand
    place[order] = np.arange(blocks)
    into, out = np.empty((blocks, size)), np.empty((blocks, size))
    begin = np.cumsum(per) - per
    f, b = (np.full((len(lengths), size), 1 / size) for _ in "fb") if ends is None else (v.copy() for v in ends)
    for k in range(int(per.max(initial=0))):
        on = np.flatnonzero(per > k)
        i, j = place[begin[on] + k], place[begin[on] + per[on] - 1 - k]
        into[i] = f[on]
        f[on] = norm(np.einsum("na,nab->nb", f[on], prod[i]))
        out[j] = b[on]
        b[on] = norm(np.einsum("nab,nb->na", prod[j], b[on]))
    if only_ends:
        return f, b
    marg = np.empty_like(x)
    for t in range(BLOCK):
        k = live[t]
        if not k:
            break
        into[:k] = norm((into[:k] @ a) * x[first[:k] + t])
        marg[first[:k] + t] = into[:k]
    if messages is not None:
        messages += [x, marg.copy(), np.empty_like(x)]
    for t in range(BLOCK - 1, -1, -1):
        k = live[t]
        i = first[:k] + t
        marg[i] *= out[:k]
        if messages is not None:
            messages[2][i] = out[:k]
        out[:k] = norm((out[:k] * x[i]) @ a.T)
    return norm(marg)


def fit(samples: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model from (text, language) pairs."""
    langs = sorted({lang for _, lang in samples})
    size = len(langs)
    m = Model(langs, np.zeros((BUCKETS, size)), np.zeros((BUCKETS, size)), np.zeros((size, size)), np.empty(0, np.uint64), np.zeros((0, size)), np.zeros((size, size)))
    c, starts, ends, text = split([t for t, _ in samples])
    if not len(starts):
        return m
    label = np.array([langs.index(lang) for _, lang in samples])[text]
    h = span_hashes(c, starts, ends)
    types, pick, word = np.unique(h, return_index=True, return_inverse=True)
    seen = np.zeros((len(types), size))
    np.add.at(seen, (word, label), 1)
    member = np.zeros((len(types), size))
    for k in range(size):
        top = np.argsort(-seen[:, k], kind="stable")[:LEXICON]
        member[top[seen[top, k] >= 2], k] = 1
    known = member.any(axis=1)
    m.words, m.member = types[known], member[known]
    # n-gram positions of the word types
    s, n = starts[pick], (ends - starts)[pick]
    rows = np.repeat(np.arange(len(types)), n)
    at = np.repeat(s + 1 - (np.cumsum(n) - n), n) + np.arange(len(rows))
    two, three = grams_at(c, at)
    cols = np.concatenate([two, three, grams_at(c, s)[0]])
    del at, two, three
    rows = np.concatenate([rows, rows, np.arange(len(types))])
    prefix, suffix = affix_ids(c, s, s + n)
    # pieces of 3 to 24 words of one document, shuffled and joined to chains
    rng = np.random.default_rng(seed)
    cuts_at = [0]
    while cuts_at[-1] < len(word):
        cuts_at.append(cuts_at[-1] + int(rng.integers(3, 25)))
    edges = np.unique(np.concatenate([np.minimum(cuts_at, len(word)), np.flatnonzero(np.diff(text)) + 1]))
    pieces = [np.arange(a, b) for a, b in zip(edges, edges[1:], strict=False)]
    token = np.concatenate([pieces[i] for i in rng.permutation(len(pieces))])
    chain_word, chain_label = word[token], label[token]
    lengths = np.full(len(token) // BLOCK, BLOCK)
    if len(token) % BLOCK:
        lengths = np.append(lengths, len(token) % BLOCK)
    inner = np.ones(len(token), bool)
    inner[np.cumsum(lengths) - lengths] = False
    here = np.flatnonzero(inner)
    truth = np.zeros((len(types), size))
    np.add.at(truth, (chain_word, chain_label), 1)
    moved = np.zeros((size, size))
    np.add.at(moved, (chain_label[here - 1], chain_label[here]), 1)
    chains = max(1, CELLS // max(size * size, BLOCK * size))  # at once
    params = [m.grams, m.lexicon, m.move, m.affixes]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        per_type = np.zeros((len(types), size))
        for k in range(size):
            per_type[:, k] = np.bincount(rows, weights=m.grams[cols, k], minlength=len(types)) + m.affixes[prefix, k] + m.affixes[suffix, k]
        per_type += member @ m.lexicon
        law, expect, links = np.exp(m.move), np.zeros((len(types), size)), np.zeros((size, size))
        for lo in range(0, len(lengths), chains):
            own, said = slice(lo * BLOCK, (lo + chains) * BLOCK), []
            q = marginals(per_type[chain_word[own]], lengths[lo : lo + chains], m.move, said)
            for k in range(size):
                expect[:, k] += np.bincount(chain_word[own], weights=q[:, k], minlength=len(types))
            # expected transitions: exp(move) times the sum over words of what comes from before and from behind, by their product
            x, forward, backward = said
            here = np.flatnonzero(inner[own])
            f, g = forward[here - 1], x[here] * backward[here]
            links += (f / np.maximum(((f @ law) * g).sum(axis=1, keepdims=True), 1e-300)).T @ g
        gap = (truth - expect) / len(token)
        g_grams = np.stack([np.bincount(cols, weights=gap[rows, k], minlength=BUCKETS) for k in range(size)], axis=1)
        g_move = (moved - law * links) / len(token)
        g_affixes = np.stack([np.bincount(prefix, weights=gap[:, k], minlength=BUCKETS) + np.bincount(suffix, weights=gap[:, k], minlength=BUCKETS) for k in range(size)], axis=1)
        for i, g in enumerate((g_grams, member.T @ gap, g_move, g_affixes)):
            g = g - DECAY * params[i] / size
            mean[i] = 0.9 * mean[i] + 0.1 * g
            var[i] = 0.99 * var[i] + 0.01 * g * g
            params[i] += RATE * (mean[i] / (1 - 0.9**step)) / (np.sqrt(var[i] / (1 - 0.99**step)) + 1e-9)
    return m


def held_out(doc: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, each: int = SAMPLE) -> list[tuple[str, str]]:
    """At most `each` labelled documents of each language that are not held out: those with the least hashes of id and text."""
    own = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    sizes = own.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    share = SAMPLE_BYTES // max(1, sizes.count())
    spread = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 40))  # by the text too, so that repeated ids spread
    near = own.join(F.broadcast(sizes), "lang").withColumn("spread", spread).where(F.col("spread") < F.lit(float(1 << 40)) * F.least(F.lit(1.0), F.lit(2 * each + 20) / F.col("rows")))
    w = Window.partitionBy("lang").orderBy("spread", "doc_id", F.coalesce("text", F.lit("")))
    upto = F.sum(utf8_bytes()).over(w.rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumns({"nth": F.row_number().over(w), "upto": upto}).where((F.col("nth") <= each) & (F.col("text") != "") & ((F.col("upto") <= share) | (F.col("upto") == utf8_bytes())))
    rows = near.select("lang", "nth", "text").collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["nth"]))]


def chains(m: Model, c: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: np.ndarray):
    """(first word, first chain, lengths of chains, marginals) of bounded stretches of the words of chains laid end to end.

    A chain that is too long for a stretch goes in parts: a pass from its beginning keeps what enters each part from
    before, a pass from its end gives the marginals, so they are those of the whole chain. Its parts come last first.
    """
    size = len(m.languages)
    per = max(1, CELLS // max(size * size, BLOCK * size))  # blocks of a stretch
    begin = np.concatenate([[0], np.cumsum(lengths)])
    for lo, hi in runs((-(-lengths // BLOCK)).tolist(), per):
        a, z = begin[lo], begin[hi]
        if z - a <= per * BLOCK:
            yield a, lo, lengths[lo:hi], marginals(emissions(m, c, starts[a:z], ends[a:z]), lengths[lo:hi], m.move)
            continue
        cuts, flat = [*range(a, z, per * BLOCK), z], np.full((1, size), 1 / size)
        into = [flat]
        for p, q in zip(cuts, cuts[1:-1], strict=False):
            into.append(marginals(emissions(m, c, starts[p:q], ends[p:q]), np.array([q - p]), m.move, ends=(into[-1], flat), only_ends=True)[0])
        back = flat
        for p, q, f in reversed(list(zip(cuts[:-1], cuts[1:], into, strict=True))):
            e, n = emissions(m, c, starts[p:q], ends[p:q]), np.array([q - p])
            yield p, lo, n, marginals(e, n, m.move, ends=(f, back))
            back = marginals(e, n, m.move, ends=(f, back), only_ends=True)[1]


def judged(m: Model, parts: list[str], each: bool = False) -> tuple[list[str], list[float], tuple]:
    """Language and score of each text, and (best language, its marginal, start, end) of the words if `each`."""
    if not m.languages:
        return [UNKNOWN] * len(parts), [0.0] * len(parts), (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
    c, starts, ends, text = split(parts)
    n = np.bincount(text, minlength=len(parts))
    total = np.zeros((len(parts), len(m.languages)))
    own = np.unique(text)
    top, sure = (np.empty(len(starts), np.int64), np.empty(len(starts))) if each else (None, None)
    for a, chain, lengths, q in chains(m, c, starts, ends, n[own]) if len(starts) else ():
        total[own[chain : chain + len(lengths)]] += np.add.reduceat(q, np.cumsum(lengths) - lengths, axis=0)
        if each:
            top[a : a + len(q)], sure[a : a + len(q)] = q.argmax(axis=1), q.max(axis=1)
    best = total.argmax(axis=1)
    names = [m.languages[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)]
    scores = [min(1.0, float(total[i, b] / k)) if k else 0.0 for i, (b, k) in enumerate(zip(best, n, strict=True))]
    return names, scores, (top, sure, starts, ends)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with lang_pred and score of each text; a column of those names in `keep` gives way to them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages weights and at most LEXICON words a language
    keep = tuple(c for c in keep if c.lower() not in ("lang_pred", "score"))

    def make(batches):
        m = shared.value
        for b in batches:
            parts = texts(b.column("text"))
            for lo, hi in runs([len(x) + 1 for x in parts], max(1 << 12, BATCH_BYTES * 8 // max(8, len(m.languages)))):
                names, scores, _ = judged(m, parts[lo:hi])
                cols = [b.column(c).slice(lo, hi - lo) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    need = docs.select(*(F.col(f"`{c}`") for c in [*keep, *(["text"] if "text" not in keep else [])]))
    fields = ", ".join(f"`{c}` {need.schema[c].dataType.simpleString()}" for c in keep)
    return in_arrow(need, make, f"{fields}, lang_pred string, score double")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, lang, score): runs of words of one language, in code points of the lower-cased text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches):
        for b in batches:
            parts, ids = texts(b.column("text")), b.column("doc_id").to_pylist()
            for i, part in enumerate(parts):
                _, _, (best, sure, starts, ends) = judged(shared.value, [part], each=True)
                if not len(starts):
                    continue
                edge = np.concatenate([[0], np.flatnonzero(np.diff(best)) + 1, [len(best)]])
                rows = [(ids[i], int(starts[a] - 1), int(ends[z - 1] - 1), shared.value.languages[best[a]], float(sure[a:z].mean())) for a, z in zip(edge, edge[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True)], names=["doc_id", "start", "end", "lang", "score"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, start long, end long, lang string, score double")
