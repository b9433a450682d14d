"""Language of texts by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The likelihood of a word is
the sum over all its segmentations into pieces, by the forward algorithm; a text's is the product over its
words. Probabilities are fitted by expectation-maximisation on a bounded sample of labelled rows
(``PER_LANGUAGE`` rows of a language on average, and of all languages together about ``SAMPLE_BYTES``, one whole row of each
language at least); prediction reads whole texts. A word's likelihoods are computed once in a worker and remembered.

Words are runs of letters (ASCII letters and all bytes from 0x80), lower-cased for ASCII and Latin-1. Words of more than
``LONG`` bytes are learned from and scored whole too, side by side and with logarithms of the sums; in fitting, rows of a language are left
out of the sample that would bring more than ``LONG_BYTES`` of such words (but for one row of each language). Defined results: a null text, or one without any letter, is ``und`` with score 0, and so are all texts if there is
nothing to learn from; ties go to the language whose name sorts first; null ids are held out of learning; rows are judged one by one.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnflow.llm import textvec as tv
from cairnflow.llm.shared import held_out, lean_batches

PER_LANGUAGE = 1000
SAMPLE_BYTES = 64 << 20
LONG, LONG_BYTES = 40, 256 << 10
ROUNDS = 4
#: Languages beyond which the model is refused: it is sent to all workers.
MOST_LANGUAGES = 256
MOST_WORDS = 1 << 20
_END = 0xFF
_BITS = 21

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0x80:] = True


def _byte_chars() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a word-level byte-pair vocabulary as bytes, with an end byte where a piece ends a word."""
    with open(path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    to = _byte_chars()
    out = {bytes(to[c] for c in p.removesuffix("</w>")) + bytes([_END] * p.endswith("</w>")) for p in pieces}
    return sorted(p for p in out | {bytes([b]) for b in range(256)} if p)


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    """Hashes of byte rows of one width."""
    return tv.mix((tv._VALUE[rows] * tv._POW[: rows.shape[1]]).sum(axis=1, dtype=np.uint64) + np.uint64(rows.shape[1]))


class Pieces:
    """Finds the pieces among the substrings of words."""

    def __init__(self, pieces: list[bytes]):
        self.n, self.longest = len(pieces), max(map(len, pieces))
        by = {}
        for i, p in enumerate(pieces):
            by.setdefault(len(p), []).append(i)
        self.sizes = sorted(by)
        self.hash = np.zeros(self.n + 1, np.uint64)
        for size, ids in by.items():
            self.hash[ids] = _hash_rows(np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8).reshape(-1, size))
        self.tables = []
        left = np.arange(self.n)
        for shift in (43, 22, 1):
            slot = self._slot(self.hash[left], shift)
            table = np.full(1 << _BITS, self.n, np.int32)
            table[slot] = left
            self.tables.append((shift, table))
            left = left[table[slot] != left]
        if len(left):
            raise ValueError("the vocabulary's hashes collide")

    @staticmethod
    def _slot(h: np.ndarray, shift: int) -> np.ndarray:
        return ((h >> np.uint64(shift)) & np.uint64((1 << _BITS) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes; ``n`` where there is none."""
        out = np.full(len(h), self.n, np.int32)
        open_ = np.arange(len(h))
        for shift, table in self.tables:
            got = table[self._slot(h[open_], shift)]
            hit = (self.hash[got] == h[open_]) & (got < self.n)
            out[open_[hit]] = got[hit]
            open_ = open_[~hit & (got < self.n)]
        return out

    def substrings(self, words: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
        """For words of one length (rows of bytes): per end place, (start, piece numbers)."""
        n, size = words.shape
        p = np.zeros((n, size + 1), np.uint64)
        np.cumsum(tv._VALUE[words] * tv._POW[:size], axis=1, out=p[:, 1:])
        return [[(i, self.find(tv.mix((p[:, j] - p[:, i]) * tv._INV[i] + np.uint64(j - i)))) for i in (j - k for k in reversed(self.sizes) if k <= j)] for j in range(1, size + 1)]


def forward(found: list[list[tuple[int, np.ndarray]]], prob: np.ndarray) -> list[np.ndarray]:
    """Sums over all segmentations of each prefix; ``prob`` has a row per piece, the last one zero."""
    n = len(found[0][0][1])
    alpha = [np.ones((n, prob.shape[1]))]
    for ends in found:
        alpha.append(sum(alpha[i] * prob[ids] for i, ids in ends))
    return alpha


def forward_long(data: np.ndarray, ws: np.ndarray, we: np.ndarray, finder: Pieces, prob: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all segmentations of words of any length, each followed by the end byte.

    All words go on by one byte at a time, the longest first. The pieces that end there are found for a stretch of
    bytes at once; the sums over the last prefixes stand in a ring as long as the longest piece and are
    scaled down together, so that neither memory nor range grows with a word.
    """
    order = np.argsort(ws - we, kind="stable")
    ws, size = ws[order], (we - ws)[order] + 1
    ring, n, langs = finder.longest + 1, len(ws), prob.shape[1]
    alpha, scale, out = np.zeros((ring, n, langs)), np.zeros((n, langs)), np.empty((n, langs))
    alpha[0] = 1
    sizes = np.array(finder.sizes)
    at, last = 0, int(size[0])
    while at < last:
        m = int(np.searchsorted(-size, -at, "left"))  # words with more than ``at`` bytes
        stretch = min(last - at, max(16, (1 << 20) // (m * len(sizes))))
        begin = max(0, at - finder.longest)
        place = np.arange(begin, at + stretch)
        raw = data[np.minimum(ws[:m, None] + place, len(data) - 1)]
        raw = np.where(place == (size[:m] - 1)[:, None], np.uint8(_END), raw)
        p = np.zeros((m, len(place) + 1), np.uint64)
        np.cumsum(tv._VALUE[raw] * tv._POW[: len(place)], axis=1, out=p[:, 1:])
        ids = np.full((stretch, len(sizes), m), finder.n, np.int32)
        for c, k in enumerate(finder.sizes):
            t = np.arange(max(at + 1, k), at + stretch + 1)
            j = t - begin
            if len(t):
                ids[t - at - 1, c] = finder.find(tv.mix((p[:, j] - p[:, j - k]) * tv._INV[j - k] + np.uint64(k)).ravel()).reshape(m, -1).T
        some = (ids < finder.n).any(axis=2)
        for t in range(at + 1, at + stretch + 1):
            m = int(np.searchsorted(-size, -t, "right"))
            c = np.flatnonzero(some[t - at - 1])
            alpha[t % ring, :m] = (alpha[(t - sizes[c]) % ring, :m] * prob[ids[t - at - 1, c, :m]]).sum(axis=0)
            if t % 16 == 0:
                most = alpha[:, :m].max(axis=0)
                most[most <= 0] = 1
                alpha[:, :m] /= most
                scale[:m] += np.log(most)
            if size[m - 1] == t:
                ends = np.flatnonzero(size[:m] == t)
                out[ends] = np.log(np.maximum(alpha[t % ring, ends], 1e-300)) + scale[ends]
        at += stretch
    back_to = np.empty(n, np.int64)
    back_to[order] = np.arange(n)
    return out[back_to]


def _expected(found, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces, each word counted by its row of ``weight`` (words, languages)."""
    alpha = forward(found, prob)
    beta = [np.zeros_like(alpha[0]) for _ in alpha]
    beta[-1] += 1
    out = np.zeros_like(prob)
    share = weight / np.maximum(alpha[-1], 1e-300)
    for j in range(len(found), 0, -1):
        for i, ids in found[j - 1]:
            step = prob[ids] * beta[j]
            beta[i] += step
            used = alpha[i] * step * share
            for k in range(prob.shape[1]):
                out[:, k] += np.bincount(ids, used[:, k], minlength=len(prob))
    return out


def expected_long(data: np.ndarray, ws: np.ndarray, we: np.ndarray, finder: Pieces, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The same as ``_expected`` for words of any length, each followed by the end byte: forward and backward sums as logarithms.

    The longest words come first, so that at each place those that reach it are the first ones.
    """
    order = np.argsort(ws - we, kind="stable")
    ws, size, weight = ws[order], (we - ws)[order] + 1, weight[order]
    n, top, langs = len(ws), int(size[0]), prob.shape[1]
    place = np.arange(top)
    raw = data[np.minimum(ws[:, None] + place, len(data) - 1)]
    raw = np.where(place == (size - 1)[:, None], np.uint8(_END), raw)
    p = np.zeros((n, top + 1), np.uint64)
    pow_, inv = tv._powers(tv._BASE, top + 1), tv._powers(pow(tv._BASE, -1, 1 << 64), top + 1)
    np.cumsum(tv._VALUE[raw] * pow_[:top], axis=1, out=p[:, 1:])
    reach = np.searchsorted(-size, -np.arange(top + 1), "right")  # words with so many bytes at least

    def ending(t: int) -> list[tuple[int, np.ndarray]]:
        """(start, piece numbers of the words that reach t) where some word has a piece."""
        starts = [t - k for k in finder.sizes if k <= t]
        ids = finder.find(tv.mix((p[: reach[t], t, None] - p[: reach[t], starts]) * inv[starts] + (t - np.array(starts)).astype(np.uint64)).ravel()).reshape(reach[t], -1)
        return [(i, ids[:, c]) for c, i in enumerate(starts) if (ids[:, c] < finder.n).any()]

    found = [ending(t) for t in range(1, top + 1)]
    ahead, back = np.zeros((top + 1, n, langs)), np.full((top + 1, n, langs), -np.inf)
    for t in range(1, top + 1):
        m, base = reach[t], ahead[t - 1, : reach[t]]
        ahead[t, :m] = base + np.log(sum(np.exp(ahead[i, :m] - base) * prob[ids] for i, ids in found[t - 1]))
    back[size, np.arange(n)] = 0
    whole = ahead[size, np.arange(n)]
    out = np.zeros_like(prob)
    for t in range(top, 0, -1):
        m = reach[t]
        for i, ids in found[t - 1]:
            step = np.log(np.maximum(prob[ids], 1e-300)) + back[t, :m]
            back[i, :m] = np.logaddexp(back[i, :m], step)
            used = np.exp(ahead[i, :m] + step - whole[:m]) * weight[:m]
            for k in range(langs):
                out[:, k] += np.bincount(ids, used[:, k], minlength=len(prob))
    out[-1] = 0
    return out


def letters(batch_bytes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, then start, end and text of every run of letters."""
    data = tv.LOWER[batch_bytes]
    after = np.concatenate([[0], batch_bytes[:-1]]) == 0xC3
    data[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    mask = np.zeros(len(data) + 1, bool)
    mask[:-1] = _LETTER[data]
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    mask &= np.cumsum(inside) > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    first = mask & ~np.concatenate([[False], mask[:-1]]) | mask & edge
    ws = np.flatnonzero(first)
    we = np.flatnonzero(mask[:-1] & (~mask[1:] | first[1:])) + 1
    return data, ws, we, np.searchsorted(starts, ws, "right") - 1


def _by_length(data: np.ndarray, ws: np.ndarray, we: np.ndarray):
    """For each length: places of the words, and their rows of bytes with the end byte."""
    size = we - ws
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, np.concatenate([data[ws[at, None] + np.arange(n)], np.full((len(at), 1), _END, np.uint8)], axis=1)


def _within(texts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The rows, by a hash of their text, that keep each language's bytes in long words within LONG_BYTES; one row of each language at least."""
    _, ws, we, row = letters(*tv.buffers(pa.array([t for _, t in texts], pa.large_string())))
    size = we - ws
    long = np.bincount(row, np.where(size > LONG, size, 0), minlength=len(texts))
    used, out = {}, {}
    for i in sorted(range(len(texts)), key=lambda i: (zlib.crc32(texts[i][1].encode("utf-8", "replace")), texts[i])):
        lang = texts[i][0]
        if used.get(lang, 0) + long[i] <= LONG_BYTES:
            used[lang] = used.get(lang, 0) + long[i]
            out.setdefault(lang, []).append(i)
    for lang in {lang for lang, _ in texts} - set(out):
        out[lang] = [min((i for i in range(len(texts)) if texts[i][0] == lang), key=lambda i: long[i])]
    return [texts[i] for i in sorted(i for rows in out.values() for i in rows)]


def fit(texts: list[tuple[str, str]], pieces: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Languages, and for each piece (and a last row of zeros) its probability in every language."""
    langs = sorted({lang for lang, _ in texts})
    texts = _within(texts)
    data, ws, we, row = letters(*tv.buffers(pa.array([t for _, t in texts], pa.large_string())))
    h = tv.word_hashes(data, ws, we)
    _, example, which = np.unique(h, return_index=True, return_inverse=True)
    of = np.array([langs.index(lang) for lang, _ in texts])[row]
    weight = np.bincount(which * len(langs) + of, minlength=len(example) * len(langs)).reshape(-1, len(langs)).astype(float)
    finder = Pieces(pieces)
    prob = np.full((len(pieces) + 1, len(langs)), 1 / len(pieces))
    prob[-1] = 0
    ws, we = ws[example], we[example]
    short, long = np.flatnonzero(we - ws <= LONG), np.flatnonzero(we - ws > LONG)
    groups = [(short[at[k : k + 8192]], rows[k : k + 8192]) for at, rows in _by_length(data, ws[short], we[short]) for k in range(0, len(at), 8192)]
    long = long[np.argsort(ws[long] - we[long], kind="stable")]
    width = [max(1, (1 << 21) // len(langs) // int(n)) for n in we[long] - ws[long]]
    chunks, at = [], 0
    while at < len(long):
        chunks.append(long[at : at + width[at]])
        at += width[at]
    for _ in range(ROUNDS):
        count = np.zeros_like(prob)
        for at, rows in groups:
            count += _expected(finder.substrings(rows), prob, weight[at])
        for at in chunks:
            count += expected_long(data, ws[at], we[at], finder, prob, weight[at])
        count += 0.1 + 0.1 * count.sum(axis=1, keepdims=True) / max(1.0, count.sum()) * 100  # unseen pieces keep a share, common ones more
        prob = count / count[:-1].sum(axis=0)
        prob[-1] = 0
    return langs, prob


class Scorer:
    """Log likelihoods of words in every language, remembered by the word's hash."""

    def __init__(self, pieces: list[bytes], prob: np.ndarray):
        self.finder, self.prob = Pieces(pieces), prob
        self._clear()

    def _clear(self) -> None:
        self.known, self.value = np.zeros(0, np.uint64), np.zeros((0, self.prob.shape[1]), np.float32)

    def texts(self, column: pa.Array) -> np.ndarray:
        """Log likelihoods of whole texts (rows) in every language."""
        data, ws, we, row = letters(*tv.buffers(column))
        out = np.zeros((len(column), self.prob.shape[1]))
        if not len(ws):
            return out
        unique, example, which = np.unique(tv.word_hashes(data, ws, we), return_index=True, return_inverse=True)
        if len(self.known) > MOST_WORDS:
            self._clear()
        at = np.searchsorted(self.known, unique)
        new = at >= len(self.known)
        new[~new] = self.known[at[~new]] != unique[~new]
        if new.any():
            fresh = example[new]
            value = np.empty((len(fresh), self.prob.shape[1]), np.float32)
            size = we[fresh] - ws[fresh]
            short, long = np.flatnonzero(size <= LONG), np.flatnonzero(size > LONG)
            for places, rows in _by_length(data, ws[fresh[short]], we[fresh[short]]):
                for k in range(0, len(places), 8192):
                    value[short[places[k : k + 8192]]] = np.log(np.maximum(forward(self.finder.substrings(rows[k : k + 8192]), self.prob)[-1], 1e-300))
            if len(long):
                value[long] = forward_long(data, ws[fresh[long]], we[fresh[long]], self.finder, self.prob)
            known = np.concatenate([self.known, unique[new]])
            order = np.argsort(known)
            self.known, self.value = known[order], np.concatenate([self.value, value])[order]
            at = np.searchsorted(self.known, unique)
        for k in range(self.prob.shape[1]):
            out[:, k] = np.bincount(row, self.value[at, k][which], minlength=len(column))
        return out


_scorers: dict[str, Scorer] = {}


def _predict(model, langs: list[str], pieces_path: str, name: str, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if langs and name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(vocabulary(pieces_path), model.value)
        for batch in batches:
            for part in tv.pieces(batch):
                n = part.num_rows
                best, score = np.zeros(n, np.int64), np.zeros(n)
                known = np.zeros(n, bool)
                if langs:
                    ll = _scorers[name].texts(part.column("text"))
                    best = ll.argmax(axis=1)
                    score = 1 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1)
                    data, starts, ends = tv.buffers(part.column("text"))
                    ascii_ = np.concatenate([[0], np.cumsum(_LETTER[data] & (data < 0x80))])
                    known = ascii_[ends] > ascii_[starts]
                    for i in np.flatnonzero(~known & (ends > starts)):
                        known[i] = any(c.isalpha() for c in data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace"))
                names = [langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], names=[*carried, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, vocabulary_path: str, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the posterior of the prediction under equal priors)."""
    import uuid

    lean_batches(docs)
    spark = docs.sparkSession
    learn = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("at"))
    size = learn.groupBy("lang").agg(F.count("*"), F.sum(F.octet_length("text")), F.min("at")).limit(MOST_LANGUAGES + 1).collect()
    if len(size) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs, prob = [], np.zeros((1, 0))
    if size:
        room = SAMPLE_BYTES // len(size)
        keep = F.create_map(*(x for lang, n, total, first in size for x in (F.lit(lang), F.lit(max(first, int(min(1.0, per_language / n, room / max(1, total)) * (1 << 40)))))))[F.col("lang")]
        before = Window.partitionBy("lang").orderBy("at", "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
        chosen = learn.where(F.col("at") <= keep).withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).where(F.col("before") < room)
        texts = sorted(zip(*(c.to_pylist() for c in chosen.select("lang", "text").toArrow().columns), strict=True))
        if texts:
            langs, prob = fit(texts, vocabulary(vocabulary_path))
    model = spark.sparkContext.broadcast(prob)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return out.mapInArrow(_predict(model, langs, vocabulary_path, uuid.uuid4().hex, ["doc_id", "held_out"]), "doc_id long, held_out boolean, lang_pred string, score double")
