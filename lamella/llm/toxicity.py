"""Toxicity scores from subword bags: a text's words are bags of character n-grams that share hashed vectors.

A word's vector is the mean of its n-grams' vectors (3 to 5 characters, with word borders), a text's vector is the
mean over its words, and a linear softmax turns it into a probability. Vectors and softmax are trained together by Adam
in numpy, so a misspelling never seen in training still scores through the n-grams that it shares.

Fitting takes a bounded sample of labelled rows: of each class about ``SAMPLE_ROWS`` documents, chosen by a
hash of the id, and words that occur in ``MIN_DOCS`` of them at least. Of documents that share a labelled id, one is taken. Scores cover all
rows and whole texts. As everything after the n-grams is linear, a word adds one number to its text's mean, which is remembered by word.
The mean isn't the plain one: it counts ``NEUTRAL`` words of no weight besides the text's own, and no word for more than ``MOST_SHARE`` of it.

Defined results: null and empty texts score as a bag without words, by the softmax's bias alone. Null ids pass
through. Without labelled rows of both classes every score is 0. Very long texts count whole. A score at the threshold is
toxic. Repeated rows get equal scores; no rows: no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._join import by_text
from ._memo import WordMemo, padded
from ._memory import tidy
from ._words import LOWER, U64, slabs, span_hash, word_spans

SAMPLE_ROWS = 2500
BUCKET_BITS = 16
MIN_DOCS = 3
#: Words without any weight that every text's mean counts besides its own, so a few words alone say little.
NEUTRAL = 20
#: No word counts for more than this share of a text, however often it is repeated.
MOST_SHARE = 0.01
DIM = 4
GRAMS = (3, 4, 5)


@dataclass
class ToxicityModel:
    vectors: np.ndarray  # buckets x dimensions
    softmax: np.ndarray  # dimensions x 2
    bias: np.ndarray  # 2

    def gram_logits(self) -> np.ndarray:
        """What each n-gram adds to the difference of the two logits."""
        return (self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float64)


def grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every character n-gram of words written as <word>; each word has at least one."""
    text, offs = padded(data, start, end, b"<", b">")
    text = LOWER[text]
    heads = np.flatnonzero((text & 0xC0) != 0x80)
    word = np.searchsorted(offs, heads, "right") - 1
    tails = np.append(heads, len(text))
    chars = np.bincount(word, minlength=len(start))
    buckets, owners = [], []
    for n in (*GRAMS, 0):
        if n:
            at = np.flatnonzero(word[: len(word) - n + 1] == word[n - 1 :]) if len(word) >= n else np.zeros(0, np.int64)
            a, b, w = heads[at], tails[at + n], word[at]
        else:  # the whole word, also for words too short for any n-gram
            w = np.flatnonzero(chars > 0)
            a, b = offs[w], offs[w + 1]
        buckets.append((span_hash(text, a, b, lower=False) >> U64(64 - BUCKET_BITS)).astype(np.int64))
        owners.append(w)
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], owner[order]


def _rows_sum(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sums of ``values`` by ``row``, which is sorted."""
    out = np.zeros((rows, values.shape[1]), values.dtype)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    if len(first):
        out[row[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different words' bytes with their starts and ends, then which of them each word is and which text it is in."""
    words: dict[int, bytes] = {}
    keys, rows, at = [], [], 0
    for part, data, offs in slabs(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])]), "t"):
        start, end, text = word_spans(data, offs)
        key = span_hash(data, start, end)
        raw = data.tobytes()
        for k, i in zip(*(a.tolist() for a in np.unique(key, return_index=True))):
            if k not in words:
                words[k] = raw[start[i] : end[i]]
        keys.append(key)
        rows.append(text + at)
        at += part.num_rows
    names, which = np.unique(np.concatenate(keys), return_inverse=True)
    spelled = [words[k] for k in names.tolist()]
    end = np.cumsum([len(b) for b in spelled])
    return np.frombuffer(b"".join(spelled), np.uint8), end - [len(b) for b in spelled], end, which, np.concatenate(rows)


def fit(texts: list[str], labels: np.ndarray, rounds: int = 140, rate: float = 0.15, seed: int = 7) -> ToxicityModel:
    """Full-batch Adam on the weighted cross entropy; both classes weigh the same."""
    data, start, end, which, text = _bags(texts)
    words, docs = len(start), len(texts)
    size = np.bincount(text, minlength=docs) + NEUTRAL
    pair, times = np.unique(text * words + which, return_counts=True)
    d, w = pair // words, pair % words
    common = np.bincount(w, minlength=words) >= MIN_DOCS
    keep, name = common[w], np.cumsum(common) - 1
    d, w, times = d[keep], name[w[keep]], times[keep]
    bucket, owner = grams(data, start[common], end[common])
    words = int(common.sum())
    f = np.float32
    weight = (np.minimum(times, np.maximum(1, MOST_SHARE * size[d])) / size[d]).astype(f)[:, None]
    back = np.argsort(w, kind="stable")
    d_back, w_back, weight_back = d[back], w[back], weight[back]
    used, local = np.unique(bucket, return_inverse=True)
    share = (1 / np.bincount(owner, minlength=words)).astype(f)[:, None]
    by = np.argsort(local, kind="stable")
    local_by, owner_by = local[by], owner[by]
    rng = np.random.default_rng(seed)
    y = labels.astype(int)
    vectors = rng.normal(0, 0.01, (len(used), DIM)).astype(f)
    vectors[:, 0] += _log_odds(np.bincount(w, y[d] == 1, words)[owner], np.bincount(w, y[d] == 0, words)[owner], local, len(used))
    softmax = rng.normal(0, 0.01, (DIM, 2)).astype(f)
    softmax[0] += (-1, 1)
    bias = np.zeros(2, f)
    word = _rows_sum(vectors[local], owner, words) * share
    slope, level = _line(_rows_sum(word[w] * weight, d, docs)[:, 0].astype(float), y)
    softmax[0] *= slope / 2
    bias += np.array([-level / 2, level / 2], f)
    importance = (0.5 / np.maximum(np.bincount(y, minlength=2), 1))[y].astype(f)[:, None]
    params = [vectors, softmax, bias]
    m, v, scale = [np.zeros_like(p) for p in params], [0.0] * 3, (len(used), 1, 1)
    for step in range(1, rounds + 1):
        word = _rows_sum(vectors[local], owner, words) * share
        doc = _rows_sum(word[w] * weight, d, docs)
        z = doc @ softmax + bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        p[np.arange(docs), y] -= 1
        p *= importance
        g_doc = p @ softmax.T
        g_word = _rows_sum(g_doc[d_back] * weight_back, w_back, words) * share
        grads = [_rows_sum(g_word[owner_by], local_by, len(used)), doc.T @ p + 1e-5 * softmax, p.sum(0)]
        for k, (x, g) in enumerate(zip(params, grads)):
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.05 * (float((g * g).sum()) - v[k])
            x -= rate * (1 - (step - 1) / rounds) * np.sqrt(scale[k]) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.95**step)) + 1e-12)
    word = _rows_sum(vectors[local], owner, words) * share
    margin = _rows_sum(word[w] * weight, d, docs) @ (softmax[:, 1] - softmax[:, 0])
    slope, level = _line(margin.astype(float), y)
    softmax *= slope
    bias = np.array([-level / 2, level / 2], f)
    whole = np.zeros((1 << BUCKET_BITS, DIM), f)
    whole[used] = vectors
    return ToxicityModel(whole, softmax, bias)


def _log_odds(pos: np.ndarray, neg: np.ndarray, gram: np.ndarray, grams_: int) -> np.ndarray:
    """Where training starts: an n-gram's log odds, or 0 where its two counts don't differ by four standard errors."""
    a, b = np.bincount(gram, pos, grams_), np.bincount(gram, neg, grams_)
    na, nb = max(a.sum(), 1), max(b.sum(), 1)
    pooled = (a + b) / (na + nb)
    z = (a / na - b / nb) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / na + 1 / nb))
    odds = np.log((a + 0.5) / (na + 1)) - np.log((b + 0.5) / (nb + 1))
    return np.where(np.abs(z) > 4, odds, 0)


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and level of a one-variable logistic fit with equal class weights and a light ridge, by Newton steps."""
    scale = max(float(x.std()), 1e-9)
    x = x / scale
    w = (0.5 / np.maximum(np.bincount(y, minlength=2), 1))[y]
    t = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(t[0] * x + t[1], -30, 30)))
        g = np.array([(w * (p - y) * x).sum() + 1e-3 * t[0], (w * (p - y)).sum()])
        q = w * p * (1 - p)
        h = np.array([[(q * x * x).sum() + 1e-3, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-6]])
        t -= np.clip(np.linalg.solve(h, g), -3, 3)
    return float(t[0]) / scale, float(t[1])


def _judge(model: ToxicityModel | None):
    """Per slab of texts ``t``: (its rows, scores)."""
    logits, bias = (None, 0.0) if model is None else (model.gram_logits(), float(model.bias[1] - model.bias[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        def make(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
            bucket, owner = grams(data, start, end)
            n = len(start)
            return (np.bincount(owner, logits[bucket], n) / np.bincount(owner, minlength=n))[:, None]

        memo = WordMemo(1, make)
        for rows, data, offs in slabs(batches, "t"):
            n = rows.num_rows
            if logits is None:
                p = np.zeros(n)
            else:
                value, which, text = memo.slab(data, offs)
                size = np.bincount(text, minlength=n) + NEUTRAL
                pair, times = np.unique(text * max(len(value), 1) + which, return_counts=True)
                text, which = pair // max(len(value), 1), pair % max(len(value), 1)
                mean = np.bincount(text, value[which, 0] * np.minimum(times, np.maximum(1, MOST_SHARE * size[text])), n) / size
                p = 1 / (1 + np.exp(-np.clip(mean + bias, -500, 500)))
            yield rows, p

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel | None:
    """Fit on about ``sample_rows`` labelled documents per class; None where a class is missing.

    The sample is drawn from the labels, which are small, so one scan of the texts finds it by a broadcast
    of at most four times ``sample_rows`` ids. One task holds the sample; only the model reaches the driver.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    spot: Column = F.pmod(F.xxhash64("i", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 0, min(1.0, sample_rows / max(sizes.get(0, 1), 1))).otherwise(min(1.0, sample_rows / max(sizes.get(1, 1), 1)))
    taken = F.broadcast(marks.where(spot < share).distinct().orderBy(spot, "i", "y").limit(4 * sample_rows))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    found = rows.join(taken, "i").groupBy("i", "y").agg(F.min("t").alias("t")).select("t", "y").repartition(1).mapInArrow(tidy(_fit_task), "vectors binary, softmax binary, bias binary").first()
    if found is None:
        return None
    vectors, softmax, bias = (np.frombuffer(bytes(x), np.float32) for x in found)
    return ToxicityModel(vectors.reshape(-1, DIM), softmax.reshape(DIM, 2), bias)


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fit on the whole, bounded sample in one task, away from the driver; no row where a class is missing."""
    texts, labels = [], []
    for batch in batches:
        texts += batch.column(0).to_pylist()
        labels += batch.column(1).to_pylist()
    if len(set(labels)) == 2:
        order = sorted(range(len(texts)), key=lambda k: (labels[k], texts[k]))  # the shuffle's order must not matter
        m = fit([texts[k] for k in order], np.array([labels[k] for k in order]))
        parts = [x.astype(np.float32).tobytes() for x in (m.vectors, m.softmax, m.bias)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], names=["vectors", "softmax", "bias"])


def score(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row; higher means label 1 is likelier."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    judge = _judge(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, p in judge(batches):
            yield pa.RecordBatch.from_arrays([found.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(tidy(run), "doc_id long, score double")


def toxic_score(text: Column, model: ToxicityModel | None) -> Column:
    """The score that ``score`` gives a text."""
    return by_text(_judge(model), text)
