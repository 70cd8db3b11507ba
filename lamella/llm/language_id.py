"""Language identification by unigrams over a fixed public vocabulary, marginalised over segmentations.

Each language has a probability for every piece of the vocabulary and for every single byte. The probability of
a word is the sum over all ways to cut it into pieces, by a forward algorithm with rescaling that runs over many words
and all languages at once. A text's evidence is the sum of its words' log probabilities.

Fitting is expectation maximisation over segmentations, on a bounded sample: of each language about
``sample_bytes`` of text (``SAMPLE_BYTES``), chosen by a hash of id and text, one copy of each. Words longer than ``WINDOW`` bytes, as
scripts without spaces have, are fitted in pieces of so many bytes, cut between characters. Prediction covers all rows and whole texts.
Pieces of the vocabulary longer than ``MOST_PIECE`` bytes are left out of it, for every language alike.

Defined results: ``und`` and score 0 for a null text or one without any letter. Texts that only repeat get equal
results. Very long texts and words are summed whole, with rescaling. Of languages that explain a text equally well, the first by name is
predicted, with a score of one half at most. Null ids pass through; without labelled rows every text is ``und``; no rows: no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._join import by_text
from ._memo import WordMemo, padded
from ._memory import tidy
from ._vocab import vocabulary_path
from ._words import LOWER, U64, slabs, span_hash

SAMPLE_BYTES = 600_000
MOST_PIECE = 16
STEP = 16
WINDOW = 40
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


class Pieces:
    """The vocabulary's pieces as byte strings, with a space for the word mark, then all single bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = (k for k in range(sp.vocab_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k)))
        whole = {sp.id_to_piece(k).replace("▁", " ").encode() for k in normal}
        texts = sorted(p for p in whole if 1 < len(p) <= MOST_PIECE) + [bytes([b]) for b in range(256)]
        self.size = len(texts)
        self.lengths = sorted({len(p) for p in texts})
        data = np.frombuffer(b"".join(texts), np.uint8)
        end = np.cumsum([len(p) for p in texts])
        start = end - np.array([len(p) for p in texts])
        key = span_hash(data, start, end, lower=False)
        bits = (8 * self.size).bit_length()
        self.shift = U64(64 - bits)
        self.slot = np.full(1 << bits, -1, np.int32)
        self.key = key
        at = (key >> self.shift).astype(np.int64)
        left = np.arange(self.size, dtype=np.int32)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slot) - 1)

    def find(self, key: np.ndarray) -> np.ndarray:
        at = (key >> self.shift).astype(np.int64)
        found = self.slot[at]
        todo = np.flatnonzero((found >= 0) & (self.key[found] != key))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slot) - 1)
            found[todo] = self.slot[at[todo]]
            todo = todo[(found[todo] >= 0) & (self.key[found[todo]] != key[todo])]
        return found


@dataclass
class Lattice:
    """All pieces in a run of words: words sorted by falling length; edges[i] lists (word, length, piece) that end at i."""

    order: np.ndarray
    sizes: np.ndarray
    edges: list[list[tuple[int, np.ndarray, np.ndarray]]]


def lattice(pieces: Pieces, data: np.ndarray, offs: np.ndarray) -> Lattice:
    sizes = np.diff(offs)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = offs[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    edges: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(longest + 1)]
    for length in pieces.lengths:
        room = np.maximum(sizes - length + 1, 0)
        n = int(room.sum())
        if not n:
            continue
        word = np.repeat(np.arange(len(sizes)), room)
        inside = np.arange(n) - np.repeat(np.cumsum(room) - room, room)
        at = begin[word] + inside
        piece = pieces.find(span_hash(data, at, at + length, lower=False))
        hit = np.flatnonzero(piece >= 0)
        stop = inside[hit] + length
        by = np.argsort(stop, kind="stable")
        word, piece, stop = word[hit][by], piece[hit][by], stop[by]
        cut = np.searchsorted(stop, np.arange(longest + 2))
        for i in range(length, longest + 1):
            if cut[i] < cut[i + 1]:
                edges[i].append((length, word[cut[i] : cut[i + 1]], piece[cut[i] : cut[i + 1]]))
    return Lattice(order, sizes, edges)


def forward(lat: Lattice, prob: np.ndarray) -> np.ndarray:
    """Log probability per word, in the lattice's order, and language; alphas are rescaled every few positions."""
    words, langs, longest = len(lat.sizes), prob.shape[1], len(lat.edges) - 1
    alpha = np.zeros((longest + 1, words, langs))
    alpha[0] = 1
    scale = np.zeros((words, langs))
    ends = np.zeros((words, langs))  # each word's scale where it ends
    for i in range(1, longest + 1):
        a = alpha[i]
        for length, word, piece in lat.edges[i]:
            a[word] += alpha[i - length, word] * prob[piece]
        if i % STEP == 0:
            n = int(np.searchsorted(-lat.sizes, -i, "right"))
            top = a[:n].copy()
            alpha[max(0, i - MOST_PIECE + 1) : i + 1, :n] /= top
            scale[:n] += np.log(top)
        done = slice(int(np.searchsorted(-lat.sizes, -i, "left")), int(np.searchsorted(-lat.sizes, -i, "right")))
        ends[done] = scale[done]
    return np.log(alpha[lat.sizes, np.arange(words)]) + ends


def expected_counts(lat: Lattice, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in one language, by forward and backward sums; for parts of ``WINDOW`` bytes, whose sums stay in range."""
    words, longest = len(lat.sizes), len(lat.edges) - 1
    alpha, beta = np.zeros((longest + 1, words)), np.zeros((longest + 1, words))
    alpha[0] = 1
    for i in range(1, longest + 1):
        for length, word, piece in lat.edges[i]:
            alpha[i, word] += alpha[i - length, word] * prob[piece]
    beta[lat.sizes, np.arange(words)] = 1
    for i in range(longest, 0, -1):
        for length, word, piece in lat.edges[i]:
            beta[i - length, word] += beta[i, word] * prob[piece]
    share = weight[lat.order] / alpha[lat.sizes, np.arange(words)]
    out = np.zeros(len(prob))
    for i in range(1, longest + 1):
        for length, word, piece in lat.edges[i]:
            out += np.bincount(piece, alpha[i - length, word] * beta[i, word] * prob[piece] * share[word], len(prob))
    return out


def windows(word: bytes, most: int = WINDOW) -> list[bytes]:
    """The word in parts of at most ``most`` bytes, cut between characters of UTF-8."""
    out, at = [], 0
    while len(word) - at > most:
        to = at + most
        while to > at + most - 4 and word[to] & 0xC0 == 0x80:
            to -= 1
        out.append(word[at:to])
        at = to
    return [*out, word[at:]]


@dataclass
class LanguageModel:
    languages: list[str]
    prob: np.ndarray  # pieces x languages
    path: str


def fit(samples: dict[str, list[str]], path: str, rounds: int = 3) -> LanguageModel:
    """Piece probabilities per language by expectation maximisation, smoothed with the mean of all languages."""
    pieces = Pieces(path)
    names = sorted(samples)
    counts = np.zeros((pieces.size, len(names)))
    for k, name in enumerate(names):
        words: dict[bytes, int] = {}
        for text in samples[name]:
            for w in text.encode().lower().split():
                for part in windows(w):
                    words[part] = words.get(part, 0) + 1
        if not words:
            continue
        data = np.frombuffer(b"".join(b" " + w for w in words), np.uint8)
        offs = np.cumsum([0] + [len(w) + 1 for w in words])
        weight = np.array(list(words.values()), float)
        lat = lattice(pieces, data, offs)
        prob = np.full(pieces.size, 1 / pieces.size)
        for _ in range(rounds):
            c = expected_counts(lat, prob, weight)
            prob = (c + 1e-3) / (c.sum() + 1e-3 * pieces.size)
        counts[:, k] = c
    if not names:
        return LanguageModel([], counts, path)
    own = counts / np.maximum(counts.sum(0), 1)
    prob = 0.97 * own + 0.02 * own.mean(1, keepdims=True) + 0.01 / pieces.size
    return LanguageModel(names, prob / prob.sum(0), path)


def has_letter(text: bytes) -> bool:
    if _ASCII_LETTER[np.frombuffer(text[:4096], np.uint8)].any():
        return True
    return regex.search(r"\p{L}", text.decode("utf-8", "replace")) is not None


def _judge(model: LanguageModel):
    """Per slab of texts ``t``: (its rows, predicted languages, scores)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
        pieces = Pieces(model.path) if model.languages else None
        langs = len(model.languages)

        def make(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
            out = np.empty((len(start), langs))
            size = end - start
            order = np.argsort(size, kind="stable")
            at = 0
            while at < len(order):
                n = int(size[order[at]])
                to = int(np.searchsorted(size[order], n + max(2, n // 4), "right"))
                to = min(to, at + max(1, 400_000 // ((n + 4) * langs)))
                which = order[at:to]
                text, offs = padded(data, start[which], end[which], b" ")
                lat = lattice(pieces, LOWER[text], offs)
                out[which[lat.order]] = forward(lat, model.prob)
                at = to
            return out

        memo = WordMemo(langs, make, 300_000)
        for rows, data, offs in slabs(batches, "t", 1 << 20):
            n = rows.num_rows
            lettered = np.array([has_letter(data[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:])], bool)
            if langs:
                score, which, text = memo.slab(data, offs)
                total = np.stack([np.bincount(text, score[which, k], n) for k in range(langs)], 1)
                words = np.maximum(np.bincount(text, minlength=n), 1)[:, None]
                total *= np.minimum(1, EVIDENCE / words)
                best = total.argmax(1)
                e = np.exp(total - total.max(1, keepdims=True))
                share = e[np.arange(n), best] / e.sum(1)
                names = [model.languages[b] if ok else "und" for b, ok in zip(best, lettered)]
                share = np.where(lettered, share, 0.0)
            else:
                names, share = ["und"] * n, np.zeros(n)
            yield rows, names, share

    return run


def _predict(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, names, share in _judge(model)(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names, pa.string()), pa.array(share, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


#: A score is the posterior on the evidence of this many average words, or of all where there are fewer.
EVIDENCE = 20


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_bytes: int = SAMPLE_BYTES, path: str | None = None) -> LanguageModel:
    """Fit on about ``sample_bytes`` of text per language. Only this sample reaches the driver."""
    rows = labelled.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t is not null and l is not null")
    sizes = {r["l"]: r["b"] for r in rows.groupBy("l").agg(F.sum(F.octet_length("t")).alias("b")).collect()}
    spot: Column = F.pmod(F.xxhash64("i", "t", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for name, size in sizes.items():
        share = F.when(F.col("l") == name, F.lit(min(1.0, sample_bytes / max(size, 1)))).otherwise(share)
    taken = rows.where(spot < share).groupBy("l", "t").agg(F.lit(1)).select("l", "t").toArrow()
    samples: dict[str, list[str]] = {name: [] for name in sizes}
    for name, text in zip(taken["l"].to_pylist(), taken["t"].to_pylist()):
        samples[name].append(text)
    return fit({k: v for k, v in samples.items() if v}, path or vocabulary_path("piece_bpe_32k.model"))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(tidy(_predict(model)), "doc_id long, lang_pred string, score double")


def language_score(text: Column, model: LanguageModel) -> Column:
    """The score that ``identify`` gives a text; 0 where it says ``und``."""
    return by_text(lambda batches: ((rows, share) for rows, _, share in _judge(model)(batches)), text)
