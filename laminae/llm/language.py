r"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability
is the sum over all its segmentations into pieces, by the forward algorithm; a text's is the product
over its words. Piece probabilities are fitted by expectation-maximisation on labelled texts.

Words are runs of ASCII letters (lower-cased, as are the two-byte Latin-1 capitals) and of bytes
above ASCII, each with a leading space, as the vocabulary has it, whatever their length. All pieces
that can occur in such words take part, and every single byte is a piece, so every word has a
probability. The vocabulary stays where it is: its path is a parameter, and tasks receive 8 bytes for
each of its pieces.

A null text, or one without a letter, is ``und`` with score 0; so is every text when nothing is
learned, and an empty table gives an empty result. Very long texts and words are scored whole, in
memory that grows with neither. Languages of equal score: the first by code point. Rows that repeat
are rows of their own. Documents of null doc_id are never learned from. Only doc_id, text and lang
are read, and lang for learning alone; further columns do not matter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import arrow_map
from .durable import durable
from .kernels import LOWER, byte_class, hash_spans, mix64, random_words, text_slices, word_spans

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Documents a language that are learned from, on average at most; rounds of fitting.
PER_LANGUAGE, ROUNDS = 400, 3
#: Words of so many bytes at most are summed many at a time, without a scale; no product of their pieces is too small for a double.
SHORT = 32
#: For fitting alone, words longer than this count as words of this length.
FIT_PART = 4096
#: Added to the expected count of every piece.
SMOOTHING = 0.02

LETTERS = byte_class(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_BYTES, _STEP = random_words(256, 21), np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A vocabulary as two hash tables of (key, number); a second place serves the few keys whose first is taken.

    What is pickled, and so goes to the tasks, are the keys: 8 bytes a piece. ``longest`` is the longest piece in bytes.
    """

    def __init__(self, keys: np.ndarray, longest: int) -> None:
        self.chosen, self.count, self.longest = keys, len(keys), longest
        bits = max(10, (13 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        slot = keys >> self.shift
        _, first = np.unique(slot, return_index=True)
        rest = np.setdiff1d(np.arange(len(keys)), first)
        for again in random_words(4000, 22) | np.uint64(1):
            second = (keys[rest] * again) >> self.shift
            if len(np.unique(second)) == len(rest):
                break
        else:
            raise ValueError("some pieces have no second place")
        self.again = again
        self.keys = [np.zeros(1 << bits, np.uint64) for _ in range(2)]
        self.numbers = [np.zeros(1 << bits, np.int32) for _ in range(2)]
        for table, numbers, at, which in zip(self.keys, self.numbers, (slot[first], second), (first, rest), strict=True):
            table[at], numbers[at] = keys[which], which

    def __reduce__(self):
        return Pieces, (self.chosen, self.longest)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's piece, or ``count``."""
        slot = keys >> self.shift
        out = np.where(self.keys[0][slot] == keys, self.numbers[0][slot], self.count)
        rest = np.flatnonzero(out == self.count)
        slot = (keys[rest] * self.again) >> self.shift
        out[rest] = np.where(self.keys[1][slot] == keys[rest], self.numbers[1][slot], self.count)
        return out


def _key(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(_STEP) + int(_BYTES[b])) % (1 << 64)
    return int(mix64(np.array([h + len(piece)], np.uint64))[0])


def vocabulary(path: str = VOCABULARY) -> Pieces:
    """The pieces of a rank file (base 64, then a number, on each line) that can occur in words, and all bytes."""
    with open(path, "rb") as lines:
        pieces = {base64.b64decode(line.split()[0]) for line in lines if line.strip()}
    usable = lambda p: p and all(LETTERS[b] and not 65 <= b <= 90 for b in p.removeprefix(b" "))
    chosen = sorted({p for p in pieces if usable(p)} | {bytes([b]) for b in range(256)})
    return Pieces(np.array([_key(p) for p in chosen], np.uint64), max(map(len, chosen)))


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the Latin-1 capitals in two bytes lower-cased."""
    out = LOWER[data]
    capital = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
    out[1:][capital] += 0x20
    return out


def spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of the words of a slice of folded bytes."""
    begin, end, before = word_spans(data, starts, LETTERS)
    return begin, end, np.repeat(np.arange(len(starts) - 1), np.diff(before))


class Lattice:
    """The segmentations of some short words, longest first, in a buffer with a space before each."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, pieces: Pieces) -> None:
        size = end - begin + 1
        self.order = np.argsort(-size, kind="stable")
        self.size = size = size[self.order]
        self.first = np.cumsum(size) - size
        total = int(size.sum())
        within = np.arange(total) - np.repeat(self.first, size)
        buffer = data[np.minimum(np.repeat(begin[self.order], size) + np.maximum(within - 1, 0), len(data) - 1)]
        buffer[within == 0] = 32
        left = np.repeat(size, size) - within
        # How many words are longer than j: they come first.
        self.active = np.searchsorted(-size, -np.arange(int(size[0]) + 1 if len(size) else 1), side="right")
        self.longest = min(pieces.longest, len(self.active) - 1)
        self.found, h = [], np.zeros(total, np.uint64)
        for length in range(1, self.longest + 1):
            # Only words of at least this length can hold such a piece.
            upto = int(size[: self.active[length]].sum())
            h = h[: upto - length + 1] * _STEP + _BYTES[buffer[length - 1 : upto]]
            number = np.full(upto, pieces.count, np.int32)
            inside = np.flatnonzero(left[: upto - length + 1] >= length)
            number[inside] = pieces.find(mix64(h[inside] + np.uint64(length)))
            self.found.append(number)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Sums over the segmentations of each start of each word (places x words x languages); ``p`` has a last row of zeros."""
        a = np.zeros((len(self.active), len(self.size), p.shape[1]))
        a[0] = 1
        for j in range(1, len(self.active)):
            n = self.active[j]
            for length in range(1, min(self.longest, j) + 1):
                number = self.found[length - 1][self.first[:n] + j - length]
                hit = np.flatnonzero(number != len(p) - 1)
                if len(hit):
                    a[j, hit] += a[j - length, hit] * p[number[hit]]
        return a

    def words(self, a: np.ndarray) -> np.ndarray:
        """Probability of each word, in the order given (words x languages)."""
        out = np.empty(a.shape[1:])
        out[self.order] = a[self.size, np.arange(len(self.size))]
        return out

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected count of each piece in each language, words counting ``weight`` (words x languages)."""
        a = self.forward(p)
        w = weight[self.order] / a[self.size, np.arange(len(self.size))]
        b = np.zeros_like(a)
        b[self.size, np.arange(len(self.size))] = 1
        out = np.zeros_like(p)
        for j in range(len(self.active) - 1, 0, -1):
            n = self.active[j]
            for length in range(1, min(self.longest, j) + 1):
                number = self.found[length - 1][self.first[:n] + j - length]
                hit = np.flatnonzero(number != len(p) - 1)
                if len(hit):
                    back = b[j, hit] * p[number[hit]]
                    np.add.at(out, number[hit], a[j - length, hit] * back * w[hit])
                    b[j - length, hit] += back
        return out


#: Numbers of one block of a march, and places between two changes of scale.
_BLOCK, _RESCALE = 1 << 18, 16


class March:
    """Long words, longest first, place by place and all at once. A window of places and their pieces is in memory, not the words' lattices."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, pieces: Pieces) -> None:
        self.data, self.pieces, self.order = data, pieces, np.argsort(begin - end, kind="stable")
        self.begin = begin[self.order]
        self.size = (end - begin + 1)[self.order]
        self.powers = np.cumprod(np.full(pieces.longest, _STEP))[::-1]
        most = pieces.longest + _BLOCK // pieces.longest + 1
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most - 1, _STEP)]))
        self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most - 1, np.uint64(pow(int(_STEP), -1, 1 << 64)))]))
        self.lengths = np.arange(pieces.longest, 0, -1).astype(np.uint64)

    def _blocks(self) -> list[tuple[int, int]]:
        out, at, most = [], 0, int(self.size[0])
        while at < most:
            n = int((self.size > at).sum())
            out.append((at, min(most, at + max(1, _BLOCK // (n * self.pieces.longest)))))
            at = out[-1][1]
        return out

    def _numbers(self, at: int, upto: int) -> np.ndarray:
        """Numbers of the pieces that end after places ``at:upto`` (places x lengths, longest first, x words)."""
        n, back = int((self.size > at).sum()), self.pieces.longest
        place = np.arange(at - back, upto)
        where = np.minimum(self.begin[:n, None] + np.maximum(place - 1, 0), len(self.data) - 1)
        byte = np.where(place == 0, np.uint8(32), self.data[where])
        term = np.where(place >= 0, _BYTES[byte], np.uint64(0))
        # A hash of all bytes up to each place, by sums of bytes over powers; a piece's own is a difference of two.
        whole = np.zeros((n, len(place) + 1), np.uint64)
        np.cumsum(term * self.inverse[: len(place)], axis=1, out=whole[:, 1:])
        whole[:, 1:] *= self.power[: len(place)]
        before = sliding_window_view(whole[:, 1:-1], back, axis=1)
        h = whole[:, back + 1 :, None] - before * self.powers + self.lengths
        return self.pieces.find(mix64(h).ravel()).reshape(h.shape).astype(np.int32).transpose(1, 2, 0)

    def _steps(self, p: np.ndarray):
        """Yield place, window (lengths x words x languages), the pieces' chances, and the sums and their scale after the place."""
        back = self.pieces.longest
        sums, scale = np.zeros((back, len(self.size), p.shape[1])), np.zeros((len(self.size), p.shape[1]))
        sums[-1] = 1
        for at, upto in self._blocks():
            numbers = self._numbers(at, upto)
            n = numbers.shape[2]
            window = np.concatenate([sums[:, :n], np.zeros((upto - at, n, p.shape[1]))])
            scale = scale[:n]
            for k in range(upto - at):
                near = window[k : k + back]
                chance = p[numbers[k]]
                new = (near * chance).sum(axis=0)
                window[k + back] = new
                yield at + k, numbers[k], near, chance, new, scale
                if (at + k) % _RESCALE == _RESCALE - 1:
                    most = np.maximum(window[k + 1 : k + back + 1].max(axis=0), 1e-300)
                    window[k + 1 : k + back + 1] /= most
                    scale = scale + np.log(most)
            sums = window[-back:]

    def scores(self, p: np.ndarray) -> np.ndarray:
        """Log-probability of each word in each language, in the order given."""
        out = np.zeros((len(self.size), p.shape[1]))
        ends = set(self.size.tolist())
        for place, _, _, _, new, scale in self._steps(p):
            if place + 1 in ends:
                done = np.flatnonzero(self.size[: len(new)] == place + 1)
                out[self.order[done]] = np.log(new[done]) + scale[done]
        return out

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected count of each piece in each language; of every place the sums are kept, so give it bounded words."""
        n, back, weight = len(self.size), self.pieces.longest, weight[self.order]
        share: list = []
        for place, numbers, near, chance, new, _ in self._steps(p):
            # Given that a piece ends here, which one: the sums' scale is the same on both sides.
            share.append((numbers, (near * chance / np.maximum(new, 1e-300)).astype(np.float32)))
        at, out = np.zeros((back + 1, n, p.shape[1])), np.zeros_like(p)
        for place in range(len(share) - 1, -1, -1):
            numbers, parts = share[place]
            here = parts.shape[1]
            at[-1][self.size == place + 1] = weight[self.size == place + 1]
            most = at[-1][:here] * parts
            np.add.at(out, numbers.ravel(), most.reshape(-1, p.shape[1]))
            at[:-1, :here] += most
            at = np.concatenate([np.zeros((1, n, p.shape[1])), at[:-1]])
        out[-1] = 0
        return out


def _split(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are short, and which are not."""
    return np.flatnonzero(end - begin < SHORT), np.flatnonzero(end - begin >= SHORT)


def _word_counts(languages: list[str]):
    where = {language: i for i, language in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array([where[x] for x in batch.column(1).to_pylist()], np.int64)
            for first, last, data, starts in text_slices(batch.column(0)):
                data = fold(data)
                begin, end, owner = spans(data, starts)
                h = hash_spans(data, begin, end)
                _, at, inverse = np.unique(h ^ langs[first:last][owner].astype(np.uint64), return_index=True, return_inverse=True)
                count, language = np.bincount(inverse, minlength=len(at)), langs[first:last][owner[at]]
                rows = [
                    (k, data[at_:min(at_ + FIT_PART, e)].tobytes(), n)
                    for b, e, k, n in zip(begin[at].tolist(), end[at].tolist(), language.tolist(), count.tolist(), strict=True)
                    for at_ in range(b, e, FIT_PART)
                ]
                ks, words, ns = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(words, pa.binary()), pa.array(ns, pa.int64())], names=["language", "word", "n"])

    return run


def _expected(pieces: Pieces, p: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(p)
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                words = part.column(1).to_pylist()
                data = np.frombuffer(b"".join(words) or b"\0", np.uint8)
                size = np.array([len(w) for w in words], np.int64)
                end = np.cumsum(size)
                begin = end - size
                weight = np.zeros((len(words), p.shape[1]))
                weight[np.arange(len(words)), part.column(0).to_numpy()] = part.column(2).to_numpy()
                short, long = _split(begin, end)
                if len(short):
                    total += Lattice(data, begin[short], end[short], pieces).expected(p, weight[short])
                for few in np.array_split(long, -(-len(long) // max(1, 32 // p.shape[1]))) if len(long) else ():
                    total += March(data, begin[few], end[few], pieces).expected(p, weight[few])
        number, language = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(number, pa.int32()), pa.array(language, pa.int32()), pa.array(total[number, language])], names=["piece", "language", "n"]
        )

    return run


@dataclass(frozen=True)
class Model:
    languages: list[str]
    pieces: Pieces
    p: np.ndarray

    def word_scores(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log-probability of each word in each language."""
        out = np.zeros((len(begin), len(self.languages)))
        short, long = _split(begin, end)
        for few in np.array_split(short, -(-len(short) // 20_000)) if len(short) else ():
            lattice = Lattice(data, begin[few], end[few], self.pieces)
            out[few] = np.log(lattice.words(lattice.forward(self.p)))
        # Words of like length go together, so that none waits for a much longer one.
        long = long[np.argsort(begin[long] - end[long], kind="stable")]
        for few in np.array_split(long, -(-len(long) // 64)) if len(long) else ():
            out[few] = March(data, begin[few], end[few], self.pieces).scores(self.p)
        return out

    def text_scores(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log-probability of each row of a slice in each language."""
        data = fold(data)
        begin, end, owner = spans(data, starts)
        rows = len(starts) - 1
        if not len(begin):
            return np.zeros((rows, len(self.languages)))
        _, at, inverse = np.unique(hash_spans(data, begin, end), return_index=True, return_inverse=True)
        scores = self.word_scores(data, begin[at], end[at])
        return np.stack([np.bincount(owner, weights=scores[inverse, k], minlength=rows) for k in range(len(self.languages))], axis=1)


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the doc_id's text leaves 2 modulo 4 (false for null)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, path: str = VOCABULARY, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit to about ``per_language`` documents of each language, chosen by a hash of doc_id; None without any.

    The driver receives the languages and, each round, an expected count for each piece of each.
    """
    taught = docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = dict(taught.groupBy("lang").count().collect())
    if not counts:
        return None
    languages = sorted(counts)
    share = F.lit(0.0)
    for language in languages:
        share = F.when(F.col("lang") == language, F.lit(per_language / counts[language])).otherwise(share)
    chosen = taught.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    words = arrow_map(chosen.select("text", "lang"), _word_counts(languages), "language int, word binary, n long")
    words = durable(words.groupBy("language", "word").agg(F.sum("n").alias("n")))
    pieces = vocabulary(path)
    p = np.full((pieces.count + 1, len(languages)), 1 / pieces.count)
    p[-1] = 0
    for _ in range(ROUNDS):
        found = arrow_map(words, _expected(pieces, p), "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        p = np.full_like(p, SMOOTHING)
        p[found["piece"].to_numpy(), found["language"].to_numpy()] += np.round(found["n"].to_numpy(), 6)
        p[-1] = 0
        p /= p.sum(axis=0)
    return Model(languages, pieces, p)


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` (posterior under equal priors) of every document."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text")
    kept = ["doc_id", "held_out"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, starts in text_slices(batch.column(3)):
                part = batch.slice(first, last - first)
                letters = np.array(part.column(2).to_pylist(), bool)
                if model is None:
                    lang, score = np.full(len(part), "und", object), np.zeros(len(part))
                else:
                    s = model.text_scores(data, starts)
                    s = np.exp(s - s.max(axis=1, keepdims=True))
                    best = s.argmax(axis=1)
                    lang = np.where(letters, np.array(model.languages, object)[best], "und")
                    score = np.where(letters, s.max(axis=1) / s.sum(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(lang, pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    return arrow_map(rows, run, f"{schema}, lang_pred string, score double")


__all__ = ["Model", "learn", "predicted", "vocabulary"]
