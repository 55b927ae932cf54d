"""Toxicity by weak supervision.

Voters are words, and beginnings of words, that labelled rows show to mark toxic documents, a fixed
word list, and patterns of address and shouting. A generative label model (a latent class with a
vote rate per voter and class) is fitted to their votes by expectation-maximisation; votes that
stay correlated within a class share their weight. Its posteriors train a linear classifier on the
votes and their number, which scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, stored

#: Words of insult that vote from the start.
INSULTS = ("bastard", "bitch", "clown", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "pig", "scum", "shit", "stupid", "trash", "vermin", "worthless")
#: Patterns that vote from the start.
PATTERNS = (r"(?i)\byou(?:'re| are) (?:an? )?(?:\w+ )?(?:idiot|moron|loser|clown|fool)", r"(?i)\bshut up\b", r"(?i)\bgo (?:to hell|die)\b", r"(?:\b[A-Z]{3,}\W+){8}")
#: Fits of the label model: after each but the last, voters' weights are set by how they go together within a class.
PHASES = 3
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of words that may vote.
STEMS = (4, 5, 6, 7)
#: Parameters of the fit: labelled rows that choose the voters, rows that the models are fitted to, voters, documents a voter must be
#: seen in, its least share of toxic ones.
LABELLED, SAMPLE, MOST_VOTERS, LEAST_SEEN, LEAST_RATE = 40_000, 20_000, 600, 6, 0.75


def features(text: str) -> tuple[set[str], list[set[str]]]:
    """The words of a text in lower case, and their beginnings by length (of longer words only)."""
    words = set(WORD.findall(text.lower()))
    return words, [{w[:n] for w in words if len(w) > n} for n in STEMS]


@dataclass
class Voters:
    words: dict[str, int]
    stems: list[dict[str, int]]
    patterns: tuple[str, ...]

    def __post_init__(self):
        self.size = len(self.words) + sum(map(len, self.stems)) + len(self.patterns)

    def votes(self, text: str) -> list[int]:
        words, stems = features(text)
        found = [self.words[w] for w in words & self.words.keys()]
        for own, known in zip(stems, self.stems):
            found += [known[s] for s in own & known.keys()]
        at = self.size - len(self.patterns)
        return found + [at + k for k, p in enumerate(self.patterns) if re.search(p, text)]


@dataclass
class Classifier:
    voters: Voters
    weights: np.ndarray  # a voter's, then that of log(1 + votes)
    bias: float

    def scores(self, votes: list[list[int]]) -> np.ndarray:
        z = np.array([self.weights[v].sum() + self.weights[-1] * np.log1p(len(v)) + self.bias for v in votes], np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def feature_counts(labelled: DataFrame) -> DataFrame:
    """labelled (text, toxic) -> feature (kind and word), n, toxic: documents that have it; summed in each task first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        bad: Counter = Counter()
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                words, stems = features(text or "")
                own = [f"0{w}" for w in words] + [f"{k}{s}" for k, some in zip(STEMS, stems) for s in some]
                n.update(own)
                if toxic:
                    bad.update(own)
        keys = list(n)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[k] for k in keys], pa.int64()), pa.array([bad[k] for k in keys], pa.int64())], names=["feature", "n", "toxic"])

    return labelled.select("text", "toxic").mapInArrow(counted, "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def chosen_voters(counted: DataFrame, share: float) -> Voters:
    """The features that raise the rate of toxic documents most surely, and the fixed ones."""
    expected = F.col("n") * share
    strong = counted.where((F.col("n") >= LEAST_SEEN) & (F.col("toxic") >= LEAST_RATE * F.col("n")))
    best = strong.orderBy(((F.col("toxic") - expected) / F.sqrt("n")).desc(), "feature").limit(MOST_VOTERS).select("feature").toArrow().column("feature").to_pylist()
    words = list(dict.fromkeys([*INSULTS, *[f[1:] for f in best if f[0] == "0"]]))
    number = iter(range(len(words) + len(best)))
    voting = {w: next(number) for w in words}
    stems = [{f[1:]: next(number) for f in best if f[0] == str(k)} for k in STEMS]
    return Voters(voting, stems, PATTERNS)


def label_model(votes: np.ndarray, times: np.ndarray, known: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """votes (patterns, voters) of 0/1; times each pattern occurs; known: the share of toxic ones among its labelled rows, or -1 if it has none
    -> posteriors, and rates and weights.

    Labels start the posteriors and are then left out, so that the posterior of each pattern is what its votes say.
    """
    q = np.where(known >= 0, known, votes.any(axis=1)).astype(np.float32)
    times = times.astype(np.float32)
    weight = np.ones(votes.shape[1], np.float32)
    on = off = weight
    for phase in range(PHASES):
        for _ in range(rounds):
            toxic, clean = q * times, (1 - q) * times
            prior = min(max(float((toxic.sum() + 1) / (times.sum() + 2)), 1e-4), 0.5)
            on = np.clip((toxic @ votes + 0.5) / (toxic.sum() + 1), 1e-5, 1 - 1e-5)
            off = np.clip((clean @ votes + 0.02) / (clean.sum() + 1), 1e-6, 1 - 1e-6)
            # A voter that is silent says little: most documents of either class have none of its words.
            said = weight * (np.log(on) - np.log(off))
            silent = weight * (np.log1p(-on) - np.log1p(-off))
            z = np.log(prior / (1 - prior)) + votes @ said + (1 - votes) @ silent
            before, q = q, (1 / (1 + np.exp(-np.clip(z, -40, 40)))).astype(np.float32)
            if np.abs(q - before).max() < 1e-4:
                break
        if phase < PHASES - 1:
            rest = (votes - (q[:, None] * on + (1 - q)[:, None] * off)) * np.sqrt(times)[:, None]
            size = np.sqrt((rest**2).sum(axis=0) + 1e-9)
            together = (rest.T @ rest) / np.outer(size, size)
            np.fill_diagonal(together, 0)
            weight = 1 / (1 + np.where(together > 0.2, together, 0).sum(axis=1))
    return q, {"on": on, "off": off, "weight": weight}


def linear(votes: np.ndarray, times: np.ndarray, target: np.ndarray, steps: int = 400, rate: float = 0.3, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by full-batch Adam; features are the votes and log(1 + their number)."""
    x = np.hstack([votes, np.log1p(votes.sum(axis=1, keepdims=True))]).astype(np.float32)
    share = (times / times.sum()).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + np.float32(b), -40, 40)))
        off = (p - target) * share
        g, gb = x.T @ off + ridge * w, float(off.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c, d = 1 - 0.9**t, 1 - 0.99**t
        w = w - rate * (m / c) / (np.sqrt(v / d) + 1e-8)
        b -= rate * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    return w, b


def calibrated(scores: np.ndarray, labelled: np.ndarray, toxic: np.ndarray) -> float:
    """The log odds from which on calling rows toxic has the best F-measure on labelled rows, with precision counting 1.4 times as much as recall: scores by pattern, and its labelled and toxic rows. 0 without toxic rows.

    Posteriors of a label model are right in order rather than in size; the limit lies between the last pattern that is taken and the next.
    """
    if not toxic.sum():
        return 0.0
    order = np.argsort(-scores, kind="stable")
    z, n, bad = scores[order], np.cumsum(labelled[order]), np.cumsum(toxic[order])
    last = np.append(z[1:] < z[:-1], True)  # a limit parts only different scores
    measure = np.where(last, 1.5 * bad / np.maximum(n + 0.5 * toxic.sum(), 1e-9), -1)
    k = int(measure.argmax())
    return float(z[k] - 1e-6 if k + 1 == len(z) else (z[k] + z[k + 1]) / 2)


def _share(n: int, most: int) -> int:
    """Of a million hash values, how many to keep so that about ``most`` of n rows stay."""
    return 1_000_000 if n <= most else int(1_000_000 * most / n)


def _hashed(seed: int) -> Column:
    """A number below a million from the id, the same whatever the partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), F.lit(1_000_000))


def fitted(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, sample: int = SAMPLE) -> Classifier:
    """docs (doc_id, text) and labels (doc_id, toxic) to learn from.

    About ``labelled`` labelled rows at most choose the voters, and about ``sample`` rows at most, labelled or not, fit the
    models (rows without a label too, so the label model sees a bounded share of all); so the labels that every task gets have a bounded size, and no text
    leaves its place. Patterns of votes reach the driver. The labels of those rows also set the limit: see ``calibrated``.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = stored(known, "toxicity-labels")
    chosen = stored(known.where(_hashed(11) < _share(known.count(), labelled)), "toxicity-chosen")
    totals = chosen.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    counted = stored(feature_counts(docs.where("text is not null").join(F.broadcast(chosen), "doc_id")), "toxicity-features")
    voters = chosen_voters(counted, totals["t"] / max(totals["n"], 1))
    part = _hashed(13) < _share(max(docs.count(), known.count()), sample)
    sampled = docs.where(part).select("doc_id", "text").join(F.broadcast(known.where(part)), "doc_id", "left")

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [sorted(voters.votes(t or "")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(v, pa.list_(pa.int32()))], names=["toxic", "votes"])

    rows = sampled.select("text", "toxic").mapInArrow(voted, "toxic int, votes array<int>")
    patterns = rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n"), F.avg("toxic").alias("known"), F.count("toxic").alias("labelled")).orderBy("votes").toArrow()
    if not patterns.num_rows:
        return Classifier(voters, np.zeros(voters.size + 1), -4.0)
    votes = np.zeros((patterns.num_rows, voters.size), np.float32)
    for i, v in enumerate(patterns.column("votes").to_pylist()):
        votes[i, v] = 1
    times = patterns.column("n").to_numpy()
    share = np.array([-1.0 if x is None else x for x in patterns.column("known").to_pylist()])
    posterior, _ = label_model(votes, times, share)
    w, b = linear(votes, times, posterior)
    labelled = patterns.column("labelled").to_numpy().astype(float)
    z = votes @ w[:-1] + w[-1] * np.log1p(votes.sum(axis=1)) + b
    return Classifier(voters, w, b - calibrated(z, labelled, labelled * np.maximum(share, 0)))


def scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with ``text``: the other columns, score (0 to 1) and predicted (1 from 0.5 on).

    Only the text is looked at; a null text is scored as the empty one. Texts of any length are read whole. Equal texts
    have equal scores. An empty table gives no rows. Columns of ``docs`` called score or predicted give way to the operator's.
    """
    docs = apart(docs, "score", "predicted")
    rest = [c for c in docs.columns if c != "text"]
    schema = docs.select(*rest).schema.add("score", "double").add("predicted", "integer")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.scores([shared.value.voters.votes(t or "") for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[*rest, "score", "predicted"])

    return docs.mapInArrow(judged, schema)
