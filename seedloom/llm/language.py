"""Language identification of mixtures.

Every document is a mixture of languages, each a distribution over byte trigrams learned
from all labelled documents. Expectation-maximisation finds a document's proportions; the
set of languages grows while the likelihood gains more than a penalty per language.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType

from .common import apart

#: Trigrams of 64 symbols. The model has a row for each that was seen, and one for all others, of a number a language.
TRIGRAMS = 1 << 18
#: What each trigram is counted besides; rounds of expectation-maximisation; the gain that a
#: language more must bring, in logarithms of the number of trigrams.
ALPHA, ROUNDS, PENALTY = 0.05, 12, 3.0
#: Bytes of a text that are looked at together.
PIECE = 1 << 20
UNKNOWN = "und"


def _symbols() -> bytes:
    """0 for what isn't a letter, 1 to 26 for letters of either case, 32 to 63 for bytes of longer characters."""
    out = bytearray(256)
    for i in range(26):
        out[65 + i] = out[97 + i] = i + 1
    for b in range(128, 256):
        out[b] = 32 + (b & 31)
    return bytes(out)


SYMBOLS = _symbols()
LETTER = re.compile(rb"[A-Za-z]")


def trigrams(text: bytes) -> np.ndarray:
    """Codes of the trigrams around each symbol that isn't a gap, with a gap at either end of the text."""
    s = np.frombuffer(b"\0" + text.translate(SYMBOLS) + b"\0", np.uint8)
    codes = (s[:-2].astype(np.int32) << 12) | (s[1:-1].astype(np.int32) << 6) | s[2:]
    return codes[s[1:-1] != 0]


def trigram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text, and how often each occurs. Of a long text a piece at a time is held, with a byte more on either side."""
    if len(text) <= PIECE:
        return np.unique(trigrams(text), return_counts=True)
    n = np.zeros(TRIGRAMS, np.int64)
    for at in range(0, len(text), PIECE):
        symbols = text[max(at - 1, 0) : at + PIECE + 1].translate(SYMBOLS)
        s = np.frombuffer((b"" if at else b"\0") + symbols + (b"\0" if at + PIECE >= len(text) else b""), np.uint8).astype(np.int32)
        codes = (s[:-2] << 12) | (s[1:-1] << 6) | s[2:]
        n += np.bincount(codes[s[1:-1] != 0], minlength=TRIGRAMS)
    codes = np.nonzero(n)[0]
    return codes, n[codes]


def has_letter(text: bytes) -> bool:
    """Whether any character is a letter, of whatever script."""
    return bool(LETTER.search(text)) or (max(text, default=0) > 127 and any(c.isalpha() for c in text.decode("utf-8", "replace")))


@dataclass
class Model:
    languages: list[str]
    row: np.ndarray  # of each trigram; the last row is that of trigrams that weren't seen
    likely: np.ndarray  # (rows, languages)
    log: np.ndarray


def counts(labelled: DataFrame) -> DataFrame:
    """labelled (lang, text) -> lang, code, n over all rows; a task sums what it reads before anything is shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.large_binary()).to_pylist()):
                if lang not in sums:
                    sums[lang] = np.zeros(TRIGRAMS, np.int64)
                codes, n = trigram_counts(text)
                sums[lang][codes] += n
        for lang, n in sums.items():
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "code", "n"])

    known = labelled.where("lang is not null and text is not null").select("lang", "text")
    return known.mapInArrow(counted, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def fitted(labelled: DataFrame) -> Model:
    """The trigram distributions of the languages of ``labelled``; at most languages times trigrams rows reach the driver."""
    summed = counts(labelled).toArrow()
    languages = sorted(set(summed.column("lang").to_pylist()))
    seen = np.unique(summed.column("code").to_numpy())
    row = np.full(TRIGRAMS, len(seen), np.int32)
    row[seen] = np.arange(len(seen))
    n = np.zeros((len(seen) + 1, len(languages)))
    number = {x: i for i, x in enumerate(languages)}
    if languages:
        n[row[summed.column("code").to_numpy()], [number[x] for x in summed.column("lang").to_pylist()]] = summed.column("n").to_numpy()
    likely = (n + ALPHA) / (n.sum(axis=0) + ALPHA * TRIGRAMS) if languages else n
    return Model(languages, row, likely.astype(np.float32), np.log(likely).astype(np.float32))


def _mixture(likely: np.ndarray, times: np.ndarray, start: np.ndarray, rounds: int) -> np.ndarray:
    """Proportions of the columns of ``likely`` (trigrams, languages) that maximise the likelihood of its rows, each of which counts ``times``."""
    share, total = start, times.sum()
    for _ in range(rounds):
        new = share * (likely.T @ (times / (likely @ share))) / total
        if np.abs(new - share).max() < 1e-3:
            return new
        share = new
    return share


def infer(text: bytes, model: Model) -> tuple[str, float, dict[str, float]]:
    """The leading language, its proportion among all, and the selected languages with their proportions.

    The set begins with the likeliest language alone. Of all others, that which makes the text likeliest joins, as long as it gains the penalty or more;
    no share is too small for it. The likelihood is concave, so its slope towards a language bounds what that one can gain, and those that
    can't gain the penalty aren't tried. Equal likelihoods leave the first by name in the lead.
    """
    codes, n = trigram_counts(text)
    k = len(model.languages)
    if not k or not len(codes) or not has_letter(text):
        return UNKNOWN, 0.0, {}
    rows, times = model.row[codes], n.astype(np.float32)
    single = n @ model.log[rows].astype(np.float64)
    first = int(single.argmax())
    if k == 1:
        return model.languages[0], 1.0, {model.languages[0]: 1.0}
    likely, total = model.likely[rows], float(n.sum())
    share = _mixture(likely, times, np.full(k, 1 / k, np.float32), ROUNDS)
    chosen, best, parts, needed = [first], single[first], np.ones(1, np.float32), PENALTY * math.log(total + 1)
    while len(chosen) < k:
        slope = likely.T @ (times / (likely[:, chosen] @ parts)) - total
        slope = np.maximum(slope, slope[chosen].max())  # what the chosen ones' own proportions may still gain
        slope[chosen] = -math.inf
        tried = []
        for other in np.nonzero(slope >= needed)[0].tolist():
            some = [*chosen, other]
            own, start = likely[:, some], np.maximum(share[some], 1e-3)
            mixed = _mixture(own, times, start / start.sum(), ROUNDS)
            tried.append((float(n @ np.log(own @ mixed).astype(np.float64)), -other, some, mixed))
        if not tried or (found := max(tried, key=lambda x: x[:2]))[0] - best < needed:
            break
        best, _, chosen, parts = found
    lead = chosen[int(parts.argmax())]
    return model.languages[lead], float(min(1.0, max(0.0, share[lead]))), {model.languages[c]: float(p) for c, p in zip(chosen, parts)}


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with ``text``: the other columns, lang_pred, score and languages (the selected set with proportions).

    A text that is null or has no letter is ``und`` with score 0, as is every text if no language was learned.
    Only the text is looked at. Texts of any length are read whole. Rows that repeat have the same result. An empty table gives no rows.
    Columns of ``docs`` called lang_pred, score or languages give way to the operator's.
    """
    docs = apart(docs, "lang_pred", "score", "languages")
    rest = [c for c in docs.columns if c != "text"]
    schema = docs.select(*rest).schema.add("lang_pred", "string").add("score", "double").add("languages", MapType(StringType(), DoubleType()))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.map_(pa.string(), pa.float64())

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [infer(t or b"", shared.value) for t in b.column("text").cast(pa.large_binary()).to_pylist()]
            langs, scores, sets = zip(*found) if found else ((), (), ())
            out = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array([list(s.items()) for s in sets], kind)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], *out], names=[*rest, "lang_pred", "score", "languages"])

    return docs.mapInArrow(labelled, schema)
