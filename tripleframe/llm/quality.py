"""Quality classifier: weak labels by expectation maximisation, then a hashed linear scorer.

1. Heuristic labellers vote good, bad or abstain on every document.
2. Spark counts the vote patterns of all documents (at most 3**5 of them).  Expectation maximisation over the
   counts estimates the share of good documents and how each labeller votes on good and on bad ones.
3. The posterior of its pattern labels each document of a sample; at most ``sample`` documents, those with
   the smallest hash of their text.  A logistic model over hashed word features is fitted to the posteriors.
4. The model scores all documents; those under ``THRESHOLD`` are rejected.

Edge cases: a text without words (NULL, empty, white space) scores 0 and is rejected; equal texts get equal
scores; if the labellers find one class only, the model says so for all; an empty table gives no rows; other columns
are not read by ``scored`` and pass through ``accepted``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tripleframe.llm.caches import claim, register

THRESHOLD = 0.3
SAMPLE = 8_000  # documents the scorer is fitted on, at most
DIMENSIONS = 1 << 15
GOOD, BAD, ABSTAIN = 1, 0, 2
CACHE_WORDS = 150_000
LABELLERS = 5
FALSE_ALARMS = 0.001  # the labellers' limits leave clean documents that much room: a labeller calls at most so many of the good bad

_ODD = re.compile(r"[#$%&*|~^<>{}\\]|!!|\?\?")


def _between(x: float, good: tuple[float, float], neither: tuple[float, float]) -> int:
    """Good inside the first range, abstaining inside the second, bad beyond."""
    return GOOD if good[0] <= x <= good[1] else ABSTAIN if neither[0] <= x <= neither[1] else BAD


class _Table(dict):
    """Codes of words, with a row of numbers for each; starts anew between texts when full."""

    def __init__(self, width: int, kind: type) -> None:
        super().__init__()
        self.rows = np.zeros((1 << 12, width), kind)

    def __missing__(self, word: str) -> int:
        code = len(self)
        if code == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[code] = self.row(word)
        self[word] = code
        return code

    def codes(self, text: str | None) -> np.ndarray:
        claim("quality")
        words = text.split() if text else []
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _plain_stem(word: str) -> str | None:
    """The word without sentence marks, if it is letters of lower case after at most one capital, as most words are."""
    stem = word.rstrip(".,;:?!")
    return stem if stem.isalpha() and (stem.islower() or stem[1:].islower()) else None


class _Facts(_Table):
    """For the labellers: odd signs, letters, capitals, signs, sentence mark at the end, no letter at all."""

    def row(self, word: str) -> tuple:
        if stem := _plain_stem(word):
            letters, capitals = len(stem), int(not stem[0].islower())
        else:
            letters, capitals = sum(map(str.isalpha, word)), sum(map(str.isupper, word))
        odd = letters < len(word) and _ODD.search(word) is not None
        return (odd, letters, capitals, len(word), word[-1] in ".,;:?!", not letters)


class _Slots(_Table):
    """For the scorer: hashed shape and last three signs."""

    def row(self, word: str) -> tuple:
        if stem := _plain_stem(word):
            capitals = int(not stem[0].islower())
            shape = ("A" if capitals else "") + "aa"[: len(stem) - capitals] + word[len(stem):]
        else:
            shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
        return (_shape_slot(shape), _end_slot(word[-3:]))


_FACTS, _SLOTS = _Facts(6, np.float32), _Slots(2, np.int32)
register("quality", _FACTS.clear)
register("quality", _SLOTS.clear)


def votes(text: str | None) -> list[int]:
    """The labellers, each for another kind of defect: odd signs, capitals, words said over and over, repeated
    lines, form of sentences.  Labellers of one kind would err together, so a kind has one.
    """
    codes = _FACTS.codes(text)
    n = len(codes)
    if not n:
        return [BAD] * LABELLERS
    odd, letters, capitals, visible, marks, bare = _FACTS.rows[codes].sum(axis=0, dtype=float).tolist()
    top = np.unique(codes, return_counts=True)[1].max() / n
    twice = np.count_nonzero(codes[1:] == codes[:-1]) / n
    lines = [x for x in text.split("\n") if x.strip()]
    again = 1 - len(set(lines)) / len(lines) if lines else 0
    long = n >= 20
    return [
        min(
            _between(odd / n, (0, 0.03), (0, 0.15)),
            _between(letters / visible, (0.85, 1), (0.7, 1)) if long else ABSTAIN,
            _between(bare / n, (0, 0.05), (0, 0.3)) if long else ABSTAIN,
        ),
        _between(capitals / max(letters, 1), (0, 0.15), (0, 0.4)) if letters >= 20 else ABSTAIN,
        min(_between(top, (0, 0.12), (0, 0.25)), _between(twice, (0, 0.03), (0, 0.1))) if long else ABSTAIN,
        _between(again, (0, 0.2), (0, 0.5)) if len(lines) >= 5 else ABSTAIN,
        min(_between(marks / n, (0.02, 0.4), (0, 0.6)), _between(visible / n, (2.5, 11), (1.8, 16))) if long else ABSTAIN,
    ]


def pattern_of(text: str | None) -> int:
    return sum(v * 3**i for i, v in enumerate(votes(text)))


def estimate(patterns: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior of being good by pattern, P(vote | class) as (labeller, class, vote), and the share of good.

    Starts from one defect being enough, as bad documents have defects of different kinds; votes of a class are
    independent; abstaining says nothing; counts are smoothed by 1.  A labeller's rate of false alarms is held
    under ``FALSE_ALARMS``: without that, the bad class would shrink to its most frequent kind of defect.
    """
    if not patterns:
        return {}, np.full((LABELLERS, 2, 2), 0.5), 0.5
    codes = np.array(sorted(patterns))
    n = np.array([patterns[c] for c in codes], float)
    vote = codes[:, None] // 3 ** np.arange(LABELLERS) % 3
    one_hot = np.eye(3)[vote][:, :, :2]  # pattern, labeller, vote
    good = np.where((vote == BAD).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        weight = np.stack([n * (1 - good), n * good])  # class, pattern
        rate = np.einsum("cp,plv->lcv", weight, one_hot) + 1
        rate /= rate.sum(axis=2, keepdims=True)
        rate[:, GOOD, BAD] = np.minimum(rate[:, GOOD, BAD], FALSE_ALARMS)
        rate[:, GOOD, GOOD] = 1 - rate[:, GOOD, BAD]
        share = weight.sum(axis=1) + 1
        share /= share.sum()
        log = np.log(share)[:, None] + np.einsum("plv,lcv->cp", one_hot, np.log(rate))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        done = np.abs(new - good).max() < 1e-9
        good = new
        if done:
            break
    return dict(zip(codes.tolist(), good.tolist())), rate, float(share[1])


def _slot(kind: str, value: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}:{value}".encode("utf-8", "surrogatepass")) % DIMENSIONS


@lru_cache(1 << 16)
def _shape_slot(shape: str) -> int:
    """Runs of one sign count as two, and the first twelve signs are looked at."""
    return _slot("shape", re.sub(r"(.)\1+", r"\1\1", shape)[:12])


@lru_cache(1 << 17)
def _end_slot(end: str) -> int:
    return _slot("end", end)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights of a text: shares of word features, and steps of how often a longer text repeats itself."""
    codes = _SLOTS.codes(text)
    n = len(codes)
    if not n:
        return np.empty(0, np.int64), np.empty(0)
    twice = np.count_nonzero(codes[1:] == codes[:-1]) / n
    fresh = len(np.unique(codes)) / n**0.8
    steps = [_slot("twice", str(min(int(twice * 20), 10))), _slot("fresh", str(min(int(fresh * 5), 15)) if n >= 20 else "short")]
    return np.append(_SLOTS.rows[codes].ravel(), steps), np.append(np.full(2 * n, 1 / n), [1.0, 1.0])


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 150, shrink: float = 1e-5) -> np.ndarray:
    """Weights (the last one is the constant) of a logistic model for soft labels, by adaptive gradient steps."""
    weights = np.zeros(DIMENSIONS + 1)
    if not rows:
        return weights
    slot = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    target = np.array([r[2] for r in rows])
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, rounds + 1):
        z = np.bincount(row, value * weights[slot], len(rows)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        slope = np.append(np.bincount(slot, value * error[row], DIMENSIONS), error.sum()) + shrink * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weights -= 0.2 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return weights


def score(text: str | None, weights: np.ndarray) -> float:
    slots, values = features(text)
    if not len(slots):
        return 0.0
    z = float(values @ weights[slots] + weights[-1])
    return 1 / (1 + np.exp(-min(max(z, -500), 500)))


def train(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The scorer's weights, from all documents' votes and at most ``sample`` documents."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pattern_of(t.as_py()) for t in batch.column(0)], pa.int32())], ["pattern"])

    counts = docs.select("text").mapInArrow(vote, "pattern int").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    good, _, _ = estimate({r["pattern"]: r["n"] for r in counts.collect()})  # at most 3**5 rows

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(0)]
            found = [features(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_summed(*f)[0].tobytes() for f in found], pa.binary()),
                    pa.array([_summed(*f)[1].tobytes() for f in found], pa.binary()),
                    pa.array([good.get(pattern_of(t), 0.5) for t in texts], pa.float64()),
                ],
                ["slots", "values", "good"],
            )

    # texts with the smallest hashes, each once: one partial aggregate row per text and task, then a cut by rank
    hashed = docs.where("text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    cut = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if cut is None:
        return fit([])
    chosen = hashed.where(F.col("h") <= cut).groupBy("h").agg(F.min("text").alias("text")).select("text")
    rows = chosen.mapInArrow(describe, "slots binary, values binary, good double").collect()  # at most ``sample`` rows
    return fit([(np.frombuffer(r["slots"], np.int32).astype(np.int64), np.frombuffer(r["values"], np.float32).astype(float), r["good"]) for r in rows])


def _summed(slots: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(slots, return_inverse=True)
    return distinct.astype(np.int32), np.bincount(place, values, len(distinct)).astype(np.float32)


def scorer(weights: np.ndarray, text: str = "text") -> Column:
    weights = weights.astype(np.float32)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series([score(t, weights) for t in texts], dtype=float)

    return scores(text)


def scored(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (of being good) and keep of every row."""
    return docs.select("doc_id", scorer(train(docs, sample)).alias("score")).withColumn("keep", F.col("score") >= threshold)


def accepted(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    return docs.where(scorer(train(docs, sample)) >= threshold)
