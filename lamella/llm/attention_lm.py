"""Language-model scores from causal self-attention over public subword ids, trained in numpy on all training documents.

    p(t | before) = sum over s of  softmax(bias[previous token] + attention(before) @ out)[s] * emit[s](t)

Attention reads the tokens before and decides how ``STATES`` output distributions over the whole vocabulary are mixed. Everything is
trained together: queries, keys, values, position weights, ``out`` and ``bias`` by back-propagation and Adam, the output
distributions by the expected counts of their states (incremental expectation maximisation, which is the same likelihood's step).

Training reads every training document. It starts from a factorisation of the counts of neighbouring frequent tokens over all training
documents, takes a first round in one task on about ``WARM`` tokens, or on all of fewer up to ``MOST_PASSES`` times, so that all trainers start
from one basis, then ``ROUNDS`` rounds that together read every training document: each round's share of the documents is
split among trainers, about one per ``TRAINER`` tokens, which step on every token of theirs, in runs of 256 blocks with the block before as
context, and whose weights are averaged by tokens and whose expected counts are summed, in tasks again; the driver holds one copy of the parameters. What is gathered (words, tokens, neighbours, expected counts) grows with the input.

Scoring lays a document's ids into blocks of 8. Each block's queries see the block before and their own past by a
causal mask, so windows of 16 overlap by half and each token is scored once, many windows per matrix product.

The word-level base score needs the count of every word of the corpus. Counts of the ``HEAD`` most frequent words are broadcast, which
covers most tokens; all others are looked up by an ordinary join. Words are named by 64-bit fingerprints.

Defined results: a null or empty text is the end token alone. Null ids count as held out of training. Very long texts are scored whole, in
blocks. Repeated rows are scored each on its own, and alike. Ties among frequent tokens go to the smaller id. Without training rows all
counts are 0, base scores are null and the model is uniform. No rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._blas import one_thread
from ._memory import tidy
from ._scratch import Scratch
from ._vocab import WordEncoder, vocabulary_path
from ._words import U64, slabs, span_hash, word_spans

HEAD = 1 << 17
ROWS = 4096  # frequent tokens with an embedding of their own
TAIL = 4  # embeddings that all other tokens share
NEIGHBOURS = 512  # frequent tokens whose neighbours start the training
STATES = 64
DIM = 16
BLOCK = 8
RUN = 64  # blocks in a step of training
WARM, MOST_PASSES = 5_000_000, 8
TRAINER, ROUNDS = 4_000_000, 2
END_WORD = np.int64(-(2**63))  # the fingerprint that stands for the end of a text
f32 = np.float32


@dataclass
class Tokens:
    row: np.ndarray  # token -> row of the embedding
    share: np.ndarray  # token -> smoothed share of all training tokens
    rows: int = ROWS + TAIL + 1  # the last row is the text's beginning

    @classmethod
    def of(cls, count: np.ndarray) -> Tokens:
        row = ROWS + np.arange(len(count)) % TAIL
        top = np.argsort(-count, kind="stable")[:ROWS]
        row[top] = np.arange(len(top))
        return cls(row.astype(np.int32), (count + 0.5) / (count + 0.5).sum())


@dataclass
class AttentionModel:
    """``weights``: e, q, k, v, n (relative positions), o, b. ``counts``: token x state, whose columns' shares are the output distributions."""

    tokens: Tokens
    weights: dict[str, np.ndarray]
    counts: np.ndarray

    def emit(self) -> np.ndarray:
        return (self.counts / self.counts.sum(0)).astype(f32)


def _layout(texts: list[np.ndarray], row: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs as rows [blocks, BLOCK], targets [blocks, BLOCK] with -1 for none, whether a block begins a text, its text)."""
    n = np.array([len(t) for t in texts], np.int64)
    blocks = -(-n // BLOCK)
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    target = np.full(total * BLOCK, -1, np.int64)
    at = np.repeat(first * BLOCK, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    if len(texts):
        target[at] = np.concatenate(texts)
    rows = np.where(target >= 0, row[target], begin)
    inputs = np.empty(total * BLOCK, np.int64)
    inputs[1:] = rows[:-1]
    inputs[first[blocks > 0] * BLOCK] = begin
    begins = np.zeros(total, bool)
    begins[first[blocks > 0]] = True
    return inputs.reshape(-1, BLOCK), target.reshape(-1, BLOCK), begins, np.repeat(np.arange(len(texts)), blocks)


_Q, _K = np.arange(BLOCK)[:, None] + BLOCK, np.arange(2 * BLOCK)[None, :]
CAUSAL = np.where(_K <= _Q, 0, -1e9).astype(f32)
RELATIVE = np.clip(_Q - _K, 0, 2 * BLOCK - 1)
SAFE = 60  # exponents of single precision up to which no maximum need be taken off
_ONES = np.ones(max(STATES, 2 * BLOCK), f32)


def _pairs_of_blocks(x: np.ndarray) -> np.ndarray:
    """Each block after the one before it."""
    before = np.concatenate([np.zeros_like(x[:1]), x[:-1]])
    return np.concatenate([before, x], 1)


def _exp(z: np.ndarray, most: float) -> np.ndarray:
    """exp in place, up to a factor per row where ``most``, a bound of the exponents that count, is large."""
    if not most < SAFE:
        z -= z.max(-1, keepdims=True)
    return np.exp(z, out=z)


def _longest(x: np.ndarray) -> float:
    """The greatest squared length of the vectors along the last axis."""
    return np.einsum("btd,btd->bt", x, x).max(initial=0)


def _attend(q: np.ndarray, k: np.ndarray, v: np.ndarray, near: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = q @ k.transpose(0, 2, 1)
    most = float(np.sqrt(_longest(q) * _longest(k)) + np.abs(near[near > -1e8]).max())
    s += near
    s[begins, :, :BLOCK] = -1e9
    _exp(s, most)
    s /= (s.reshape(-1, 2 * BLOCK) @ _ONES[: 2 * BLOCK]).reshape(*s.shape[:2], 1)
    return s, s @ v


def _states(h: np.ndarray, out: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exponentials of the states' logits, their sums) for [tokens, DIM] and [tokens, STATES]."""
    z = h @ out
    z += bias
    _exp(z, float(max(z.max(), -z.min())) if len(z) else 0)
    z += f32(1e-10)  # no state is ruled out, and no product becomes a denormal number, which is slow
    return z, z @ _ONES[:STATES]


class Scorer:
    """The tables that scoring looks up, made once for a worker's many texts; without ``attention``, the previous token's bias alone speaks."""

    def __init__(self, model: AttentionModel, attention: bool = True):
        w = model.weights
        self.tokens, self.emit, self.bias, self.out = model.tokens, model.emit(), w["b"], w["o"] if attention else np.zeros_like(w["o"])
        self.query, self.key, self.value = w["e"] @ w["q"] * f32(DIM**-0.5), w["e"] @ w["k"], w["e"] @ w["v"]
        self.near = w["n"][RELATIVE] + CAUSAL

    def log_probabilities(self, texts: list[np.ndarray], at_once: int = 512) -> np.ndarray:
        """The natural log probability of every text of token ids."""
        inputs, target, begins, text = _layout(texts, self.tokens.row, self.tokens.rows - 1)
        total = np.zeros(len(texts))
        for a in range(0, len(inputs), at_once):
            b = min(a + at_once, len(inputs))
            lead = 1 if a else 0  # the block before the first, as context only
            x = inputs[a - lead : b]
            k, v = _pairs_of_blocks(self.key[x])[lead:], _pairs_of_blocks(self.value[x])[lead:]
            x, t = x[lead:], target[a:b].ravel()
            h = _attend(self.query[x], k, v, self.near, begins[a:b])[1].reshape(-1, DIM)
            z, each = _states(h, self.out, self.bias.take(x.ravel(), 0))
            logp = np.log(np.einsum("ts,ts->t", z, self.emit.take(t, 0)) / each + f32(1e-37))
            logp = np.where(t >= 0, logp, 0).reshape(-1, BLOCK)
            total += np.bincount(text[a:b], logp.sum(1).astype(np.float64), len(texts))
        return total


def start(tokens: Tokens, neighbours: np.ndarray, seed: int = 5, steps: int = 60) -> AttentionModel:
    """Where training starts: neighbours[previous, next] of frequent tokens (then all others, then the beginning) factored into states."""
    rng = np.random.default_rng(seed)
    k = NEIGHBOURS
    c = neighbours.astype(f32)
    first = rng.dirichlet(np.ones(STATES), k + 2).astype(f32)
    then = rng.gamma(1.0, 1, (STATES, k + 1)).astype(f32) * (c.sum(0) + f32(0.5))
    then /= then.sum(1, keepdims=True)
    for _ in range(steps):
        gain = c / (first @ then + f32(1e-12))
        first, then = first * (gain @ then.T) + f32(0.02), then * (first.T @ gain) + f32(1e-6)
        first /= first.sum(1, keepdims=True)
        then /= then.sum(1, keepdims=True)
    small = np.minimum(tokens.row, k)
    rare = small == k
    emit = then.T[small].astype(float)
    emit[rare] *= (tokens.share[rare] / max(tokens.share[rare].sum(), 1e-300))[:, None]
    emit = 0.999 * emit + 0.001 * tokens.share[:, None]
    which = np.minimum(np.arange(tokens.rows), k)
    which[-1] = k + 1
    r = tokens.rows
    w = {"e": rng.normal(0, 0.3, (r, DIM)), "q": rng.normal(0, 0.25, (DIM, DIM)), "k": rng.normal(0, 0.25, (DIM, DIM)), "v": rng.normal(0, 0.25, (DIM, DIM)),
         "n": np.zeros(2 * BLOCK), "o": rng.normal(0, 0.1, (DIM, STATES)), "b": np.log(first[which] + 1e-6)}
    return AttentionModel(tokens, {n: x.astype(f32) for n, x in w.items()}, emit.astype(f32))


def _sum_by(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different indices below 2**16, sums of the rows of ``values`` at each), by halving the runs of equal indices."""
    order = np.argsort(index.astype(np.uint16), kind="stable")
    index, values = index[order], values.take(order, 0)
    first = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
    size = np.diff(np.append(first, len(index)))
    place = np.arange(len(index)) - np.repeat(first, size)
    step = 1
    left = np.flatnonzero(place)
    while len(left):  # rows at an odd multiple of the step go into the row a step before
        odd = (place[left] & step) != 0
        move = left[odd]
        values[move - step] += values[move]
        left, step = left[~odd], 2 * step
    return index[first], values.take(first, 0)


class Trainer:
    """One worker's copy of the parameters, stepped over the texts that it is given.

    ``expected`` is about how many tokens will come, over which the rate falls to a tenth. ``prior`` is the weight of the incoming output
    distributions, in tokens.
    """

    def __init__(self, model: AttentionModel, expected: float, prior: float, rate: float = 0.02, run: int = RUN, seed: int = 11):
        self.run = run
        self.row, self.begin = model.tokens.row, model.tokens.rows - 1
        self.w = {k: v.copy() for k, v in model.weights.items()}
        self.m, self.s = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        self.base = model.emit() * f32(prior)
        self.counts = self.base.copy()
        self.total = self.counts.sum(0)
        self.expected, self.rate, self.step, self.seen = max(expected, 1), rate, 0, 0
        self.rng = np.random.default_rng(seed)

    def learn(self, texts: list[np.ndarray]) -> None:
        inputs, target, begins, _ = _layout(texts, self.row, self.begin)
        for a in self.rng.permutation(np.arange(0, len(inputs), self.run)):
            lead = 0 if begins[a] else 1  # the block before the first, as context only
            t = target[a - lead : a + self.run].copy()
            t[:lead] = -1
            self._step(inputs[a - lead : a + self.run], t, begins[a - lead : a + self.run].copy())

    def _step(self, x: np.ndarray, t: np.ndarray, begins: np.ndarray) -> None:
        w, scale = self.w, f32(DIM**-0.5)
        begins[0] = True
        flat = x.ravel()
        e = w["e"].take(flat, 0)
        shape = (*x.shape, DIM)
        q, k, v = ((e @ w[n]).reshape(shape) for n in "qkv")
        q *= scale
        kk, vv = _pairs_of_blocks(k), _pairs_of_blocks(v)
        att, h = _attend(q, kk, vv, w["n"][RELATIVE] + CAUSAL, begins)
        h = h.reshape(-1, DIM)
        z, each = _states(h, w["o"], w["b"].take(flat, 0))
        z /= each[:, None]
        t = t.ravel()
        real = t >= 0
        n = int(real.sum())
        r = self.counts.take(t, 0)
        r *= 1 / self.total
        r *= z
        r /= (r @ _ONES[:STATES] + f32(1e-30))[:, None]  # each state's share in the token that came
        token, more = _sum_by(t[real], r[real])
        self.counts[token] += more
        self.total += more.sum(0)
        g = z
        g -= r
        g *= (real / max(n, 1)).astype(f32)[:, None]
        d = {"o": h.T @ g}
        dh = (g @ w["o"].T).reshape(shape)
        datt = dh @ vv.transpose(0, 2, 1)
        dvv = att.transpose(0, 2, 1) @ dh
        datt -= (datt * att).sum(2, keepdims=True)
        datt *= att
        d["n"] = np.bincount(RELATIVE.ravel(), datt.sum(0).ravel(), 2 * BLOCK).astype(f32)
        dq, dkk = datt @ kk, datt.transpose(0, 2, 1) @ q
        dq *= scale
        dk, dv = dkk[:, BLOCK:].copy(), dvv[:, BLOCK:].copy()
        dk[:-1] += dkk[1:, :BLOCK]
        dv[:-1] += dvv[1:, :BLOCK]
        de = 0
        for name, part in (("q", dq), ("k", dk), ("v", dv)):
            part = part.reshape(-1, DIM)
            d[name] = e.T @ part
            de = de + part @ w[name].T
        self.step += 1
        self.seen += n
        pace = f32(self.rate * max(1 - self.seen / self.expected, 0.1))
        rows, sums = _sum_by(flat, np.concatenate([de, g], 1))
        sums += f32(1e-12)  # squares must not become denormal numbers, which are slow
        for name, grad, speed in (("e", sums[:, :DIM], 1), ("b", sums[:, DIM:], 3)):  # only rows that occur move
            m, s = self.m[name][rows], self.s[name][rows]
            m += f32(0.1) * (grad - m)
            s += f32(0.01) * (grad * grad - s)
            self.m[name][rows], self.s[name][rows] = m, s
            m /= np.sqrt(s) + f32(1e-6)
            w[name][rows] -= pace * f32(speed) * m
        for name, grad in d.items():
            m, s = self.m[name], self.s[name]
            m += f32(0.1) * (grad - m)
            s += f32(0.01) * (grad * grad - s)
            w[name] -= pace * (m / f32(1 - 0.9**self.step)) / (np.sqrt(s / f32(1 - 0.99**self.step)) + f32(1e-8))


def merge(model: AttentionModel, prior: float, parts: list[tuple[float, dict[str, np.ndarray]]], counts: np.ndarray) -> AttentionModel:
    """The mean of the trainers' weights by tokens, and the incoming output distributions with all their expected counts added."""
    total = sum(n for n, _ in parts)
    if not total:
        return model
    mean = {k: (sum(n * w[k].astype(float) for n, w in parts) / total).astype(f32) for k in model.weights}
    return AttentionModel(model.tokens, mean, model.emit() * f32(prior) + counts)


def _pack(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)]).astype(np.float64)


def _unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    cuts = np.cumsum([like[k].size for k in sorted(like)])[:-1]
    return {k: part.reshape(like[k].shape).astype(f32) for k, part in zip(sorted(like), np.split(flat, cuts))}


def _runs(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[list[np.ndarray]]:
    """Texts of token ids, in lists of about ``most`` tokens; longer texts are cut, which costs a training step its context only."""
    held, size = [], 0
    for batch in batches:
        for raw in batch.column(0):
            ids = np.frombuffer(raw.as_buffer(), "<u2").astype(np.int64)
            for at in range(0, len(ids), most):
                held.append(ids[at : at + most])
                size += len(held[-1])
                if size >= most:
                    yield held
                    held, size = [], 0
    if held:
        yield held


CHUNK = 4096
PARTS = "key int, task int, n double, at binary, data binary"


def _train(model: AttentionModel, expected: float, prior: float, rate: float, run: int, passes: int):
    """One trainer per task; it returns its weights times its tokens (key -1) and what it added to the expected counts, by chunks of tokens."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        one_thread()
        trainer = Trainer(model, expected * passes, prior, rate, run)
        runs = _runs(batches)
        if passes > 1:
            runs = list(runs) * passes
        for texts in runs:
            trainer.learn(texts)
        if not trainer.seen:
            return
        out = [(-1, b"", (_pack(trainer.w) * trainer.seen).tobytes())]
        more = trainer.counts - trainer.base
        used = np.flatnonzero(more.any(1))
        for key in np.unique(used // CHUNK).tolist():
            at = used[used // CHUNK == key]
            out.append((key, at.astype("<i4").tobytes(), more[at].astype("<f4").tobytes()))
        task = TaskContext.get().partitionId()
        for key, at, data in out:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([task], pa.int32()), pa.array([float(trainer.seen)]), pa.array([at], pa.binary()), pa.array([data], pa.binary())], names=["key", "task", "n", "at", "data"])

    return go


def _add_parts(table: pa.Table) -> pa.Table:
    """The sum of a few trainers' rows of one key."""
    key = table["key"][0].as_py()
    if key < 0:
        at, data = b"", sum(np.frombuffer(raw.as_buffer(), "<f8") for raw in table["data"]).tobytes()
    else:
        total, hit = np.zeros((CHUNK, STATES)), np.zeros(CHUNK, bool)
        for at, raw in zip(table["at"], table["data"]):
            where = np.frombuffer(at.as_buffer(), "<i4") - key * CHUNK
            total[where] += np.frombuffer(raw.as_buffer(), "<f4").reshape(-1, STATES)
            hit[where] = True
        at, data = (np.flatnonzero(hit) + key * CHUNK).astype("<i4").tobytes(), total[hit].astype("<f4").tobytes()
    return pa.table({"key": pa.array([key], pa.int32()), "task": pa.array([table["task"][0].as_py()], pa.int32()), "n": [sum(table["n"].to_pylist())], "at": pa.array([at], pa.binary()), "data": pa.array([data], pa.binary())})


def _round(scratch: Scratch, name: str, model: AttentionModel, rows: DataFrame, trainers: int, expected: float, prior: float, rate: float, run: int, passes: int = 1) -> AttentionModel:
    """Train on ``rows`` (ids), ``trainers`` partitions of them, and add up at most 64 trainers a task until one sum is left."""
    parts = scratch.write(rows.mapInArrow(tidy(_train(model, expected, prior, rate, run, passes)), PARTS), name)
    while trainers > 1:
        trainers = -(-trainers // 64)
        parts = parts.withColumn("task", F.pmod("task", F.lit(trainers))).groupBy("key", "task").applyInArrow(_add_parts, PARTS)
    counts, weights = np.zeros_like(model.counts), []
    for row in parts.toArrow().to_pylist():  # one copy of the parameters
        if row["key"] < 0:
            weights.append((row["n"], _unpack(np.frombuffer(row["data"], "<f8") / row["n"], model.weights)))
        else:
            counts[np.frombuffer(row["at"], "<i4")] += np.frombuffer(row["data"], "<f4").reshape(-1, STATES)
    scratch.drop(name)
    return merge(model, prior, weights, counts)


def train_model(scratch: Scratch, rows: DataFrame, count: np.ndarray) -> AttentionModel:
    """The model of a table of training texts (row, ids); ``count`` are the tokens' counts in it."""
    tokens = Tokens.of(count)
    n = float(count.sum())
    pairs = rows.select("ids").mapInArrow(_neighbours(tokens), "keys array<long>, counts array<long>")
    pairs = pairs.select(F.explode(F.arrays_zip("keys", "counts")).alias("x")).groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.counts").alias("c")).toArrow()
    side = NEIGHBOURS + 2
    table = np.zeros(side * (NEIGHBOURS + 1))
    table[pairs["key"].to_numpy()] = pairs["c"].to_numpy()
    model = start(tokens, table.reshape(side, -1))
    if not n:
        return model
    spot = F.pmod(F.xxhash64("row", F.lit("attention")), F.lit(1 << 30))
    warm, passes = min(n, WARM), int(np.clip(np.ceil(WARM / n), 1, MOST_PASSES))
    some = rows.where(spot < int(min(1.0, WARM / n) * (1 << 30))).select("ids").repartition(1)
    model = _round(scratch, "warm", model, some, 1, warm, 0.05 * warm, 0.025, RUN, passes)
    each = n / ROUNDS
    for k in range(ROUNDS):
        trainers = max(1, round(each / TRAINER))
        part = rows.where(F.pmod(spot, F.lit(ROUNDS)) == k).select("ids").coalesce(trainers)
        model = _round(scratch, f"round-{k}", model, part, trainers, each / trainers, 0.3 * each, 0.015, 4 * RUN)
    return model


def _neighbours(tokens: Tokens):
    """Counts of (previous, next) among frequent tokens; all others are one, the beginning is one more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, total = NEIGHBOURS, np.zeros((NEIGHBOURS + 2) * (NEIGHBOURS + 1), np.int64)
        small = np.minimum(tokens.row, k).astype(np.int64)
        for texts in _runs(batches):
            after = [small[t] for t in texts]
            before = np.concatenate([np.concatenate([[k + 1], a[:-1]]) for a in after])
            total += np.bincount(before * (k + 1) + np.concatenate(after), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.list_(pa.int64())), pa.array([total[at]], pa.list_(pa.int64()))], names=["keys", "counts"])

    return run


def _words_and_ids(path: str, end: int, vocabulary: int):
    """Per slab: a row per document with its ids, and counts of training words and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        names = ["kind", "doc_id", "t", "train", "ids", "keys", "counts"]

        def counts(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.bool_(), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), *none, pa.array([keys], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64()))], names=names)

        single, words, ends = np.zeros(vocabulary, np.int64), [], 0
        for rows, data, offs in slabs(batches, "t"):
            n = rows.num_rows
            ids = [np.append(np.frombuffer(b, "<u4"), end).astype("<u2") for b in encoder.encode([data[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:])])]
            lists = pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), *rows.columns, pa.array([i.tobytes() for i in ids], pa.binary()), lists, lists], names=names)
            train = rows.column(2).to_numpy(False).astype(bool)
            start, stop, text = word_spans(data, offs)
            words.append(np.unique(span_hash(data, start, stop)[train[text]], return_counts=True))
            ends += int(train.sum())
            used = [i for i, ok in zip(ids, train) if ok]
            if used:
                single += np.bincount(np.concatenate(used), minlength=vocabulary)
            if sum(len(k) for k, _ in words) > 1_000_000:
                yield counts(1, *_merged(words))
                words.clear()
        if words:
            yield counts(1, *_merged(words))
        if ends:
            yield counts(1, np.array([END_WORD]), np.array([ends]))
            at = np.flatnonzero(single)
            yield counts(2, at, single[at])

    return run


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys.view(np.int64), np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _score(model: AttentionModel, head: np.ndarray, head_logs: np.ndarray, end_log: float, end_known: bool):
    """Per document: what the frequent words give, the other words' fingerprints, and the model's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        scorer = Scorer(model)
        for rows, data, offs in slabs(batches, "t", 1 << 20):
            n = rows.num_rows
            score = scorer.log_probabilities([np.frombuffer(b, "<u2").astype(np.int64) for b in rows.column(3).to_pylist()]) / np.log(10)
            start, stop, text = word_spans(data, offs)
            word = span_hash(data, start, stop).view(np.int64)
            at = np.minimum(np.searchsorted(head, word), max(len(head) - 1, 0))
            hit = head[at] == word if len(head) else np.zeros(len(word), bool)
            base = np.bincount(text[hit], head_logs[at[hit]], n) + end_log
            known = np.bincount(text[hit], minlength=n) + int(end_known)
            rest, cut = word[~hit], np.searchsorted(text[~hit], np.arange(n + 1))
            others = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(rest, pa.int64()))
            arrays = [rows.column(0), rows.column(1), pa.array(np.bincount(text, minlength=n) + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), others]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "n_tokens", "known", "base", "score", "others"])

    return run


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = 49407) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row; ``train`` marks the rows to learn from."""
    scratch = Scratch(docs.sparkSession, "attention")
    path = tokenizer or vocabulary_path("word_bpe_49k.json")
    vocabulary = max(len(WordEncoder(path).model.get_vocab()), end + 1)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"), F.coalesce(train & F.col(id_col).isNotNull(), F.lit(False)).alias("train"))
    shape = "kind int, doc_id long, t string, train boolean, ids binary, keys array<long>, counts array<long>"
    made = rows.mapInArrow(tidy(_words_and_ids(path, end, vocabulary)), shape)
    made.withColumn("row", F.monotonically_increasing_id()).write.mode("overwrite").partitionBy("kind").parquet(scratch.path("pass"))
    made = docs.sparkSession.read.schema(f"{shape}, row long").parquet(scratch.path("pass"))
    counts = made.where("kind > 0").select("kind", F.explode(F.arrays_zip("keys", "counts")).alias("x")).groupBy("kind", F.col("x.keys").alias("key")).agg(F.sum("x.counts").alias("c"))
    counts = scratch.write(counts, "counts")
    tokens = counts.where("kind = 2").select("key", "c").toArrow()  # at most the vocabulary
    single = np.zeros(vocabulary)
    single[tokens["key"].to_numpy()] = tokens["c"].to_numpy()
    texts = made.where("kind = 0")
    model = train_model(scratch, texts.where("train").select("row", "ids"), single)

    words = counts.where("kind = 1").select("key", "c")
    total, different, ends = words.agg(F.sum("c"), F.count(F.lit(1)), F.max(F.when(F.col("key") == int(END_WORD), F.col("c")))).first()
    total, ends = total or 0, ends or 0
    log = lambda c: np.log10((c + 0.5) / (total + 0.5 * (different + 1)))
    best = words.where((F.col("key") != int(END_WORD)) & (F.col("c") >= _bar(words, HEAD))).toArrow()
    order = np.argsort(best["key"].to_numpy())
    head, head_logs = best["key"].to_numpy()[order], log(best["c"].to_numpy()[order].astype(float))

    scored = texts.select("row", "doc_id", F.coalesce("t", F.lit("")).alias("t"), "ids")
    scored = scored.mapInArrow(tidy(_score(model, head, head_logs, float(log(ends)), ends > 0)), "row long, doc_id long, n_tokens long, known long, base double, score double, others array<long>")
    scored = scratch.write(scored, "scored")
    scratch.drop("pass")
    rest = scored.select("row", F.explode("others").alias("key")).groupBy("key", "row").agg(F.count(F.lit(1)).alias("n"))
    c = F.coalesce("c", F.lit(0))
    rest = rest.join(words, "key", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(total + 0.5 * (different + 1)))).alias("rest"))
    base = F.col("base") + F.coalesce("rest", F.lit(0.0))
    return scored.drop("others").join(rest, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (base if total else F.lit(None).cast("double")).alias("base_score"),
        "score",
    )


def _bar(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` keys reach, from the histogram of the counts: exact up to 1024, then by steps of an eighth."""
    c = F.col("c")
    step = F.expr("shiftleft(1L, greatest(cast(floor(log2(cast(c as double))) as int) - 3, 0))")
    level = F.when(c <= 1024, c).otherwise((c / step).cast("long") * step)
    levels = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    reached, bar = 0, None
    for at, n in levels:  # at most 1024 + 8 * 53 rows
        reached += n
        if reached > most:
            break
        bar = at
    return bar if bar is not None else 1 << 62
