"""Language-model scoring with a causal self-attention model over subword ids.

The model is one layer of causal self-attention whose output is added, through an
output matrix, to a direct path from the previous subword: a table of its successors, counted over all texts of the whole
training corpus. The output is a two-level softmax over ``SLOTS`` slots: the commonest subwords, and one slot
for all others, which share its probability by their counts. The attention parameters are trained in numpy on all windows, in shards whose
number grows with the corpus and whose parameters are averaged after each round; the counts of words, subwords and pairs, and so the choice of slots,
cover the whole corpus. In training the direct path of each place leaves out the place's own pair, so that what is learned is how far
counts can be trusted on other texts.

A text is scored in overlapping windows. Each subword is scored once, by the window that has it among its last ``STEP`` places; the
``OVERLAP`` before them are read alone.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, scratch, stored
from .subwords import WordIds, word_ids

#: Slots as GROUPS groups of MEMBERS; length of a window and what it shares with the one before.
GROUPS, MEMBERS, WINDOW, OVERLAP = 32, 32, 64, 16
SLOTS, OTHER = GROUPS * MEMBERS, GROUPS * MEMBERS - 1
#: Stands where a text hasn't begun or has ended: no weight falls on it.
GONE = SLOTS
HEADS, KEY, VALUE = 2, 8, 16
#: The vocabulary of the tokenizer and the id that ends a text.
VOCABULARY, END = 50257, 50256
#: How ids, and VOCABULARY where there is none, are stored.
CODE = np.dtype("<u2")
#: Training: windows of a shard.
SHARD = 24_000
#: Words whose counts every task holds; longer words than so many bytes go by their digest.
TOP_WORDS, LONG_WORD = 100_000, 256
#: Training: rounds, windows a step, rate of Adam, pseudo-counts of the successor table.
ROUNDS, BATCH, RATE, PRIOR = 5, 48, 0.01, 4.0
#: Training: blocks of parameters and moments that are averaged apart.
BLOCKS = 256
#: Exponents of attention weights and of logits in training are held below this; batches of windows whose outputs are computed together.
MOST, TOGETHER = 60.0, 2
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
STEP = WINDOW - OVERLAP
#: Distance of each place of a window (columns) before each that it scores (rows).
BACK = OVERLAP + np.arange(STEP)[:, None] - np.arange(WINDOW)[None, :]
CAUSAL, DISTANCE = BACK >= 0, np.maximum(BACK, 0)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def word_key(word: bytes) -> bytes:
    """What a word meets its count by: itself, or its digest if it is long."""
    return word if len(word) <= LONG_WORD else b"\0" + hashlib.sha256(word).digest()


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sequences of ``lengths`` inputs laid end to end: of each window its sequence, its places, which of them are the sequence's, and which of
    its last STEP are scored."""
    n = -(-lengths // STEP)
    own = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    place = STEP * k[:, None] - OVERLAP + np.arange(WINDOW)
    real = (place >= 0) & (place < lengths[own][:, None])
    return own, (np.cumsum(lengths) - lengths)[own][:, None] + place, real, real[:, OVERLAP:]


@dataclass
class Model:
    """Tables of queries, keys and values by slot, biases by distance, output matrices, and the direct path's tables."""

    slot: np.ndarray  # of each id
    rare: np.ndarray  # log probability of an id within OTHER; 0 for ids with a slot of their own
    direct: np.ndarray  # (GROUPS, SLOTS, MEMBERS): log of the successor's probability within its group
    direct_group: np.ndarray  # (SLOTS, GROUPS)
    p: dict[str, np.ndarray]
    less: np.ndarray | None = None  # (SLOTS, SLOTS), (SLOTS, GROUPS): what a pair loses in the direct path's tables
    less_group: np.ndarray | None = None  # if one occurrence of it isn't counted

    def heads(self, table: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Rows of a table by head (HEADS, slots, its width per head) for x (windows, places), as (HEADS, windows, places, width)."""
        return table.take(x, axis=1)

    def by_head(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Queries, keys and, with what sums the weights, values; for GONE there are zeros. And the weights by distance, as factors."""
        tables = []
        for name, width in (("q", KEY), ("k", KEY), ("v", VALUE + 1)):
            own = self.p[name].reshape(SLOTS, HEADS, -1)
            table = np.zeros((HEADS, SLOTS + 1, width), own.dtype)
            table[:, :SLOTS, : own.shape[2]] = own.transpose(1, 0, 2)
            tables.append(table)
        tables[2][:, :SLOTS, VALUE] = 1
        near = np.exp(self.p["r"]).take(DISTANCE, axis=1)
        near *= CAUSAL
        return *tables, near[:, None]

    def settled(self) -> Model:
        """Once trained: the tables by head, the direct path's tables as they are weighed."""
        self.queries, self.keys, self.values, self.near = self.by_head()
        self.direct, self.direct_group = self.direct * self.p["cm"], self.direct_group * self.p["cg"]
        self.less = self.less_group = None
        return self

    def attended(self, x: np.ndarray) -> np.ndarray:
        """x (windows, WINDOW) of slots or GONE -> (windows, STEP, HEADS * VALUE), once ``settled``. What a place that is GONE itself gets means nothing."""
        s = _weights(self.heads(self.queries, x[:, OVERLAP:]), self.heads(self.keys, x), self.near)
        o = np.matmul(s, self.heads(self.values, x))
        out = o[..., :VALUE] / np.maximum(o[..., VALUE:], np.float32(1e-30))
        return out.transpose(1, 2, 0, 3).reshape(len(x), STEP, HEADS * VALUE)

    def log_probability(self, a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logarithms of slot y after slot x with attention output a, for each row, once ``settled``."""
        order = np.argsort((y // MEMBERS).astype(np.uint8), kind="stable")
        a, x, y = a.take(order, axis=0), x.take(order), y.take(order)
        g, m = y // MEMBERS, y % MEMBERS
        row = np.arange(len(y))
        z = a @ self.p["wg"]
        z += self.direct_group.take(x, axis=0)
        inside = np.empty_like(z)
        bounds = np.searchsorted(g, np.arange(GROUPS + 1))
        for k in range(GROUPS):
            i = slice(bounds[k], bounds[k + 1])
            np.matmul(a[i], self.p["wm"][k], out=inside[i])
            inside[i] += self.direct[k].take(x[i], axis=0)
        lp = z[row, g] + inside[row, m]
        ones = np.ones(max(GROUPS, MEMBERS), np.float32)  # sums by a product: rows are short
        lp -= np.log((np.exp(z, out=z) @ ones[:GROUPS]) * (np.exp(inside, out=inside) @ ones[:MEMBERS]))
        out = np.empty_like(lp)
        out[order] = lp
        return out

    def scores(self, sequences: list[np.ndarray], chunk: int = 128) -> np.ndarray:
        """Natural logarithms of the probabilities of texts given as ids without END, which is scored too."""
        lengths = np.array([len(s) + 1 for s in sequences], np.int64)
        end = np.array([END], np.uint32)
        ids = np.concatenate([z for s in sequences for z in (s, end)]) if len(sequences) else end[:0]
        y = self.slot[ids]
        x = np.empty_like(y)
        x[1:] = y[:-1]
        if len(x):
            x[np.cumsum(lengths) - lengths] = self.slot[END]
        own, places, real, scored = windows(lengths)
        total = np.zeros(len(sequences))
        rare = np.nonzero(y == OTHER)[0]
        np.add.at(total, np.searchsorted(np.cumsum(lengths), rare, side="right"), self.rare[ids[rare]])
        for whole in range(0, len(own), TOGETHER * chunk):  # many rows fill the groups of the output, few stay in the caches
            parts = []
            for at in range(whole, min(whole + TOGETHER * chunk, len(own)), chunk):
                some = slice(at, at + chunk)
                read = np.where(real[some], x.take(places[some], mode="clip"), GONE)
                inside = scored[some]
                parts.append((self.attended(read)[inside], places[some, OVERLAP:][inside], np.repeat(own[some], inside.sum(axis=1))))
            a, place, text = (np.concatenate(z) for z in zip(*parts))
            total += np.bincount(text, self.log_probability(a, x[place], y[place]), len(sequences))
        return total


def _weights(q: np.ndarray, k: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Attention weights (HEADS, windows, STEP, WINDOW), not yet divided by their sums."""
    s = np.matmul(q, np.ascontiguousarray(k.swapaxes(2, 3)))
    if s.size and s.max() > MOST:
        np.minimum(s, MOST, out=s)
    np.exp(s, out=s)
    s *= near
    return s


#: A row for each member of a group of slots: 1 at its own place.
ONE = np.eye(MEMBERS, dtype=np.float32)


def _summed(slots: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of ``rows`` (n, any) by slot; GONE gets none. By group, as products: that is faster than adding row by row."""
    order, bounds = _by_group(slots)
    one, rows = ONE.take(slots.take(order) % MEMBERS, axis=0).astype(rows.dtype, copy=False), rows.take(order, axis=0)
    out = np.empty((GROUPS, MEMBERS, rows.shape[1]), rows.dtype)
    for own, i in zip(out, _parts(bounds)):
        np.matmul(one[i].T, rows[i], out=own)
    return out.reshape(SLOTS, -1)


def _by_group(slots: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The order of ``slots`` by group, and where each group begins in it and ends; GONE comes last, after all groups."""
    g = (slots // MEMBERS).astype(np.uint8)
    return np.argsort(g, kind="stable"), [0, *np.cumsum(np.bincount(g, minlength=GROUPS + 1)[:GROUPS]).tolist()]


def _parts(bounds: list[int]) -> list[slice]:
    return list(map(slice, bounds, bounds[1:]))


def _softmax(z: np.ndarray, at: np.ndarray, count: int) -> tuple[np.ndarray, float]:
    """Of logits z (places, choices), made in place, and the choices: the gradient of the mean loss over ``count``, and the sum of losses."""
    if z.size and z.max() > MOST:
        np.minimum(z, MOST, out=z)
    np.exp(z, out=z)
    z *= (1 / (count * (z @ np.ones(z.shape[1], z.dtype))))[:, None]
    flat, place = z.reshape(-1), np.arange(0, z.size, z.shape[1]) + at
    chosen = flat.take(place)
    flat[place] = chosen - 1 / count
    return z, -float(np.log(chosen * count + 1e-30).sum())


def _gradient(m: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of a batch of windows, and its gradient by parameter. x (windows, WINDOW), y (windows, STEP): slots or GONE."""
    p, n, x, y = m.p, len(x), x.astype(np.intp), y.astype(np.intp)
    queries, keys, values, near = m.by_head()
    q, k, v = m.heads(queries, x[:, OVERLAP:]), m.heads(keys, x), m.heads(values, x)
    w = _weights(q, k, near)
    o = np.matmul(w, v)
    total = np.maximum(o[..., VALUE:], 1e-30)
    a = (o[..., :VALUE] / total).transpose(1, 2, 0, 3).reshape(n * STEP, HEADS * VALUE)
    grad = {}

    # Places with a target, by its group. Each place is told from the others' successors alone.
    order, bounds = _by_group(y.reshape(-1))
    order = order[: bounds[-1]]
    a, xs, ys = a.take(order, axis=0), x[:, OVERLAP:].reshape(-1).take(order), y.reshape(-1).take(order)
    g, member, count, row = ys // MEMBERS, ys % MEMBERS, max(len(ys), 1), np.arange(len(ys))
    own = m.direct_group.take(xs, axis=0)
    own[row, g] += m.less_group[xs, g]
    z = a @ p["wg"]
    z += p["cg"] * own
    d, loss = _softmax(z, g, count)
    grad["wg"], grad["cg"], da = a.T @ d, np.array([np.vdot(d, own)], d.dtype), d @ p["wg"].T
    own = m.direct.reshape(-1, MEMBERS).take(g * SLOTS + xs, axis=0)
    own[row, member] += m.less[xs, ys]
    parts = _parts(bounds)
    for i, wm in zip(parts, p["wm"]):
        np.matmul(a[i], wm, out=z[i])
    z += p["cm"] * own
    d, more = _softmax(z, member, count)
    grad["wm"], grad["cm"], back = np.empty_like(p["wm"]), np.array([np.vdot(d, own)], d.dtype), np.empty_like(da)
    for i, wm, out in zip(parts, p["wm"], grad["wm"]):
        np.matmul(a[i].T, d[i], out=out)
        np.matmul(d[i], wm.T, out=back[i])
    da += back

    # What reaches the weights, before they are divided by their sums: the last column is what the sums lose.
    do = np.zeros((n * STEP, HEADS, VALUE + 1), da.dtype)
    a *= da
    do[order, :, :VALUE] = da.reshape(-1, HEADS, VALUE)
    do[order, :, VALUE] = -(a.reshape(-1, VALUE) @ np.ones(VALUE, a.dtype)).reshape(-1, HEADS)
    do = do.reshape(n, STEP, HEADS, VALUE + 1).transpose(2, 0, 1, 3) / total
    ds = np.matmul(do, np.ascontiguousarray(v.swapaxes(2, 3)))
    ds *= w
    rows = np.zeros((n, WINDOW, HEADS, 2 * KEY + VALUE), ds.dtype)
    by_head = rows.transpose(2, 0, 1, 3)
    by_head[:, :, OVERLAP:, :KEY] = np.matmul(ds, k)
    by_head[..., KEY : 2 * KEY] = np.matmul(ds.swapaxes(2, 3), q)
    by_head[..., 2 * KEY :] = np.matmul(w.swapaxes(2, 3), do[..., :VALUE])
    sums = _summed(x.reshape(-1), rows.reshape(n * WINDOW, -1)).reshape(SLOTS, HEADS, -1)
    grad["q"], grad["k"], grad["v"] = (part.reshape(SLOTS, -1) for part in np.split(sums, [KEY, 2 * KEY], axis=2))
    pairs = (np.ones(n, ds.dtype) @ ds.reshape(HEADS, n, -1)).reshape(HEADS, STEP, WINDOW)
    grad["r"] = np.stack([np.bincount(DISTANCE[CAUSAL], h[CAUSAL], WINDOW) for h in pairs]).astype(ds.dtype)
    return (loss + more) / count, grad


#: What training carries from round to round: parameters and Adam's two moments of each.
State = dict[str, np.ndarray]


def started(p: dict[str, np.ndarray]) -> State:
    return {f"{kind}.{k}": (v.copy() if kind == "p" else np.zeros_like(v)) for kind in ("p", "m", "v") for k, v in p.items()}


def parameters(state: State) -> dict[str, np.ndarray]:
    return {k[2:]: v for k, v in state.items() if k.startswith("p.")}


def flattened(state: State) -> np.ndarray:
    return np.concatenate([v.ravel() for v in state.values()])


def unflattened(values: np.ndarray, like: State) -> State:
    ends = np.cumsum([v.size for v in like.values()])
    return {k: part.reshape(v.shape).astype(np.float32, copy=False) for (k, v), part in zip(like.items(), np.split(values, ends[:-1]))}


def one_round(m: Model, state: State, x: np.ndarray, y: np.ndarray, number: int, rounds: int) -> tuple[State, float]:
    """A pass of Adam over windows (see ``_gradient``) from ``state``, as round ``number`` (from 0) of ``rounds``: the new state and the mean loss."""
    every = flattened(state)
    state = unflattened(every, state)  # parts of ``every``
    value, first, second = np.split(every, 3)
    m = replace(m, p=parameters(state))
    g, change = np.empty_like(value), np.empty_like(value)
    parts = unflattened(g, m.p)
    order, seen = np.random.default_rng(5 + number).permutation(len(x)), []
    steps = max(1, -(-len(x) // BATCH))
    for k in range(-(-len(x) // BATCH)):
        i = order[k * BATCH : (k + 1) * BATCH]
        loss, grad = _gradient(m, x[i], y[i])
        seen.append(loss)
        for name, part in parts.items():
            part[...] = grad[name]
        t = number * steps + k + 1
        rate = RATE * min(1.0, t / 50) * (1 - 0.95 * t / (rounds * steps))
        first *= 0.9
        first += np.multiply(g, 0.1, out=change)
        second *= 0.99
        g *= g
        second += np.multiply(g, 0.01, out=change)
        np.sqrt(second, out=change)
        change *= 1 / math.sqrt(1 - 0.99**t)
        change += 1e-8
        np.divide(first, change, out=change)
        change *= rate / (1 - 0.9**t)
        value -= change
    return state, float(np.mean(seen)) if seen else 0.0


def fresh(slot: np.ndarray, unigrams: np.ndarray, pairs: np.ndarray) -> Model:
    """An untrained model from corpus counts: ids (VOCABULARY,) and pairs of slots (SLOTS, SLOTS)."""
    rng = np.random.default_rng(3)
    own = pairs.sum(axis=0) + 0.5
    kinds = (pairs >= 1).sum(axis=1, keepdims=True) + PRIOR  # the more kinds of successors, the likelier a new one
    mass = pairs + kinds * own / own.sum()
    likely = mass / mass.sum(axis=1, keepdims=True)
    group = likely.reshape(SLOTS, GROUPS, MEMBERS).sum(axis=2)
    fewer, mass_group = mass - np.minimum(pairs, 1), mass.reshape(SLOTS, GROUPS, MEMBERS).sum(axis=2)
    less = np.log(fewer / mass)
    less_group = np.log(np.maximum(mass_group - 1, mass_group * 1e-3) / mass_group)
    others = np.where(slot == OTHER, unigrams + 0.05, 0)
    rare = np.where(slot == OTHER, np.log(np.maximum(others, 1e-9) / max(others.sum(), 1e-9)), 0)
    normal = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    p = {
        "q": normal(SLOTS, HEADS * KEY, s=0.3),
        "k": normal(SLOTS, HEADS * KEY, s=0.3),
        "v": normal(SLOTS, HEADS * VALUE, s=0.3),
        "r": np.stack([-0.02 * 20**h * np.arange(WINDOW) for h in range(HEADS)]).astype(np.float32),
        "wg": normal(HEADS * VALUE, GROUPS, s=0.1),
        "wm": normal(GROUPS, HEADS * VALUE, MEMBERS, s=0.1),
        "cg": np.ones(1, np.float32),
        "cm": np.ones(1, np.float32),
    }
    within = np.log(likely / np.repeat(group, MEMBERS, axis=1)).reshape(SLOTS, GROUPS, MEMBERS).transpose(1, 0, 2)
    return Model(slot, rare, np.ascontiguousarray(within, np.float32), np.log(group).astype(np.float32), p, less.astype(np.float32), less_group.astype(np.float32))


def targets(rows: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows to train on (see ``training_windows``) -> inputs (windows, WINDOW) and targets (windows, STEP): slots or GONE."""
    slots = np.append(slot, slot.dtype.type(GONE)).take(rows)
    x, y = slots[:, :-1], slots[:, 1 + OVERLAP :]
    return x, np.where(x[:, OVERLAP:] == GONE, slot.dtype.type(GONE), y)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary; empty for the end of a text), n over all rows; each task sums before anything is shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for text in b.column("text").cast(pa.large_binary()).to_pylist():
                n.update(words_of(text))
                n[b""] += 1
                if len(n) > 500_000:
                    yield flushed()
                    n.clear()
        yield flushed()

    return docs.select("text").mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def coded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (see ``CODE``) of docs (doc_id, text); docs that have ids already keep them."""
    if "ids" in docs.columns:
        return docs.select("doc_id", "ids")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer, lead=True)
        for b in batches:
            ids = [code_of(coder, words_of(text)) for text in b.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encoded, "doc_id long, ids binary")


def code_of(coder: WordIds, words: list[bytes]) -> bytes:
    return np.frombuffer(coder.of_words(words), "<u4").astype(CODE).tobytes()


def drawn(doc_id: int | None, n: int) -> np.ndarray:
    """64 bits for each of a text's n windows, by which they are dealt."""
    import xxhash

    z = np.uint64(xxhash.xxh64_intdigest(str(doc_id))) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def training_windows(docs: DataFrame, tokenizer: str, tokens: int) -> DataFrame:
    """part, shard, ids: all windows of ``docs`` (doc_id, and text or ids) of about ``tokens`` subwords. ids: those of WINDOW inputs and the last target (see
    ``CODE``), VOCABULARY where the text hasn't begun or has ended.

    A round takes one part: a corpus of fewer than two SHARDs of windows is one part, which each round reads whole; of a larger one there are up to ROUNDS, so
    that the rounds together read each window at least once. A part's shards, dealt by hashes, are of about SHARD windows each.
    """
    every = max(1.0, tokens / STEP)
    parts = min(ROUNDS, max(1, int(every // SHARD)))
    shards = max(1, round(every / parts / SHARD))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows, own = [np.empty((0, WINDOW + 1), CODE)], [np.empty(0, np.uint64)]
                for doc_id, data in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                    ids = np.frombuffer(data, CODE)
                    places = np.full(OVERLAP + len(ids) + 2 + WINDOW, VOCABULARY, CODE)
                    places[OVERLAP + 1 : OVERLAP + 1 + len(ids)] = ids
                    places[[OVERLAP, OVERLAP + 1 + len(ids)]] = END
                    rows.append(np.lib.stride_tricks.sliding_window_view(places, WINDOW + 1)[: len(ids) + 1 : STEP])
                    own.append(drawn(doc_id, len(rows[-1])))
                dealt, data = np.concatenate(own), np.concatenate(rows)
                ends = pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32) * np.int32(CODE.itemsize * (WINDOW + 1)))
                columns = [
                    pa.array((dealt % np.uint64(1 << 32) % np.uint64(parts)).astype(np.int32)),
                    pa.array(((dealt >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)),
                    pa.Array.from_buffers(pa.binary(), len(data), [None, ends, pa.py_buffer(data.tobytes())]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "shard", "ids"])

    return coded(docs, tokenizer).mapInArrow(cut, "part int, shard int, ids binary")


def subword_counts(vocabulary: DataFrame, tokenizer: str) -> np.ndarray:
    """Counts of ids (VOCABULARY,) over the corpus, from its words (word, n; see ``word_counts``), each encoded once for all its occurrences."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer, lead=True)
        every = np.zeros(VOCABULARY, np.int64)
        for b in batches:
            words, n = b.column("word").to_pylist(), b.column("n").to_numpy()
            coder.learn({w for w in words if w})
            coded = [np.frombuffer(coder.of_words([w]) if w else END.to_bytes(4, "little"), "<u4") for w in words]
            np.add.at(every, np.concatenate(coded), np.repeat(n, [len(c) for c in coded]))
        yield _counts(every)

    return _gathered(vocabulary.select("word", "n").mapInArrow(counted, COUNTS), VOCABULARY)


def successor_counts(docs: DataFrame, slot: np.ndarray) -> np.ndarray:
    """Counts of slots after slots (SLOTS, SLOTS) over all rows of docs (ids), within words and from one to the next; a text begins after END. Each task sums first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END], CODE).tobytes()
        every, waiting, held = np.zeros(SLOTS * SLOTS, np.int64), [], 0

        def summed() -> None:
            nonlocal waiting, held
            if waiting:
                every[:] += np.bincount(np.concatenate(waiting), minlength=SLOTS * SLOTS)
            waiting, held = [], 0

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                texts = whole.column("ids").slice(at, 256).to_pylist()
                y = slot.take(np.frombuffer(end + b"".join([z for text in texts for z in (text, end)]), CODE)).astype(np.int32)
                waiting.append(y[:-1] * SLOTS + y[1:])
                held += len(y)
                if held > 2 * SLOTS * SLOTS:
                    summed()
        summed()
        yield _counts(every)

    return _gathered(docs.select("ids").mapInArrow(counted, COUNTS), SLOTS * SLOTS).reshape(SLOTS, SLOTS)


COUNTS = "code int, n long"


def _counts(every: np.ndarray) -> pa.RecordBatch:
    at = np.nonzero(every)[0]
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(every[at])], names=["code", "n"])


def _gathered(counts: DataFrame, size: int) -> np.ndarray:
    rows = counts.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    every = np.zeros(size)
    every[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    return every


def in_order(ids: pa.ChunkedArray) -> np.ndarray:
    """Windows (binary as ``training_windows`` has them, or lists) as rows of an array, in an order that doesn't hang on partitions."""
    if pa.types.is_binary(ids.type):
        rows = np.frombuffer(b"".join(ids.to_pylist()), CODE).reshape(-1, WINDOW + 1)
    else:
        rows = np.array(ids.to_pylist(), CODE).reshape(-1, WINDOW + 1)
    return rows.take(np.argsort(rows.astype(">u2").view(f"S{2 * (WINDOW + 1)}")[:, 0], kind="stable"), axis=0)


def trained(model: Model, sample: DataFrame) -> dict[str, np.ndarray]:
    """The parameters after ROUNDS rounds over ``sample`` (shard, ids; with ``part``, each round takes the next part). In a round each shard is a task, which
    goes on from the same state; Spark averages what they come to, in BLOCKS blocks, and only that average reaches the driver."""
    spark, state, rounds = sample.sparkSession, started(model.p), ROUNDS
    last = sample.agg(F.max("part" if "part" in sample.columns else F.lit(0)), F.max("shard")).first()
    parts, shards = (last[0] or 0) + 1, (last[1] or 0) + 1
    tables = spark.sparkContext.broadcast(replace(model, p={}))

    def mean(rows: pa.Table) -> pa.Table:
        total, data = 0.0, rows.column("v").to_pylist()
        for part in data:
            total = total + np.frombuffer(part, np.float32).astype(np.float64)
        return pa.table({"i": rows.column("i")[:1], "v": pa.array([(total / len(data)).tobytes()], pa.binary())})

    for number in range(rounds):
        now = spark.sparkContext.broadcast(state)

        def one_shard(rows: pa.Table) -> pa.Table:
            m = tables.value
            after, _ = one_round(replace(m, p=parameters(now.value)), now.value, *targets(in_order(rows.column("ids")), m.slot), number, rounds)  # noqa: B023
            blocks = [part.tobytes() for part in np.array_split(flattened(after), BLOCKS)]
            return pa.table({"i": pa.array(np.arange(BLOCKS, dtype=np.int32)), "v": pa.array(blocks, pa.binary())})

        own = sample.where(F.col("part") == number % parts) if "part" in sample.columns else sample
        # More partitions than shards, so that few have two.
        ends = own.select("shard", "ids").repartition(3 * shards, "shard").groupBy("shard").applyInArrow(one_shard, "i int, v binary")
        means = ends.groupBy("i").applyInArrow(mean, "i int, v binary").toArrow().sort_by("i")
        if means.num_rows:
            state = unflattened(np.concatenate([np.frombuffer(v) for v in means.column("v").to_pylist()]), state)
    return parameters(state)


def fitted(docs: DataFrame, vocabulary: DataFrame, tokenizer: str, tokens: int) -> Model:
    """docs (doc_id, and text or ids) to learn from, their words' counts, and how many words there are: with none, the model is untrained.

    One row for each id and pair of slots, and the parameters, reach the driver.
    """
    ids = subword_counts(vocabulary, tokenizer)
    seen = ids.copy()
    seen[END] = seen.sum() + 1
    slot = np.full(VOCABULARY, OTHER, np.int16)
    best = np.argsort(-seen, kind="stable")[: SLOTS - 1]
    best = best[seen[best] > 0]
    slot[best] = np.arange(len(best))
    docs = coded(docs, tokenizer)
    model = fresh(slot, ids, successor_counts(docs, slot))
    if not tokens:
        return model.settled()
    windows_ = training_windows(docs, tokenizer, int(ids.sum()))
    path = scratch(docs.sparkSession, "lm-windows")
    windows_.write.partitionBy("part").parquet(path)  # a round reads its own part
    return replace(model, p=trained(model, docs.sparkSession.read.schema(windows_.schema).parquet(path))).settled()


def scored(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs (doc_id, held_out, text): scores of all rows by a model learned from those that aren't held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    * A null text is empty: its end is its only token. A null held_out counts as held out.
    * Rows that repeat an id, or a text, are scored each. Texts of any length are scored whole.
    * With nothing to learn from, all words are unknown and the model is untrained. An empty table gives no rows.
    """
    learned = docs.where("not held_out").select("doc_id", "text")
    word = F.col("word")
    digest = F.concat(F.unhex(F.lit("00")), F.unhex(F.sha2(word, 256)))
    vocabulary = stored(word_counts(learned).withColumn("key", F.when(F.octet_length(word) > LONG_WORD, digest).otherwise(word)), "lm-words")
    totals = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n, size = totals["n"], totals["n"] + totals["v"] + 1
    vocabulary = vocabulary.where("n > 0")
    top = vocabulary.select("key", "n").orderBy(F.col("n").desc(), "key").limit(TOP_WORDS).toArrow()
    known = dict(zip(top.column("key").to_pylist(), np.log10((top.column("n").to_numpy() + 1) / size).tolist()))
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(known)
    names = ["doc_id", "held_out", "n_tokens", "n_common", "common_score"]
    own = "doc_id long, held_out boolean, n_tokens long, n_common long, common_score double"
    rest_type = pa.list_(pa.struct([("key", pa.binary()), ("times", pa.int32())]))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, coder = held.value, word_ids(tokenizer, lead=True)
        end = common.get(b"")
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows = []
                for text in b.column("text").cast(pa.large_binary()).to_pylist():
                    found = words_of(text)
                    known = list(map(common.get, found))
                    missing = Counter([w for w, s in zip(found, known) if s is None])
                    if not missing:
                        base = sum(known)
                    else:
                        base = sum([s for s in known if s is not None])
                        for w in [w for w in missing if len(w) > LONG_WORD]:
                            times, key = missing.pop(w), word_key(w)
                            if key in common:
                                base += times * common[key]
                            else:
                                missing[key] = times
                    n_common = len(found) - missing.total()
                    if end is None:
                        missing[b""] = 1
                    else:
                        base, n_common = base + end, n_common + 1
                    rows.append((len(found) + 1, n_common, base, list(missing.items()), code_of(coder, found)))
                tokens, n_common, base, rest, ids = zip(*rows)
                out = [pa.array(tokens, pa.int64()), pa.array(n_common, pa.int64()), pa.array(base, pa.float64()), pa.array(rest, rest_type), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("held_out"), *out], names=[*names, "rest", "ids"])

    # Each text is split and encoded once: what follows reads its ids.
    texts = docs.select("doc_id", "held_out", "text").mapInArrow(met, f"{own}, rest array<struct<key: binary, times: int>>, ids binary")
    texts = stored(texts.withColumn("row", F.monotonically_increasing_id()), "lm-texts")
    shared = spark.sparkContext.broadcast(fitted(texts.where("not held_out").select("doc_id", "ids"), vocabulary, tokenizer, n))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                score = model.scores([np.frombuffer(ids, CODE) for ids in b.column("ids").to_pylist()]) / math.log(10)
                yield b.drop_columns("ids").append_column("score", pa.array(score))

    found = stored(texts.select("row", *names, "ids").mapInArrow(judged, f"row long, {own}, score double"), "lm-scores")
    # Words beyond those that every task holds: each document's distinct ones meet their counts in a join.
    rare = texts.select("row", F.inline("rest")).join(vocabulary.select("key", "n"), "key", "left")
    count = F.coalesce(F.col("n"), F.lit(0))
    sums = rare.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((count + 1) / F.lit(float(size)))).alias("rare_score"), F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("n_rare")
    )
    zero = F.lit(0)
    return found.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare", zero)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("common_score") + F.coalesce("rare_score", zero.cast("double"))).alias("base_score"),
        "score",
    )
