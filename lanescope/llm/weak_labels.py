"""Quality classifier without labels: heuristic labellers, expectation-maximisation, linear scorer.

``LABELLERS`` vote good (1), bad (0) or abstain (2) on every text.  Votes form at most 3^n patterns,
so the patterns' counts over all texts are a table of bounded size, and expectation-maximisation on
it is exact: it estimates how often each labeller votes what on good and on bad texts, and how
probable each pattern makes a good text.  Those posteriors label a bounded sample of texts, on which
a logistic scorer over hashed word shapes is trained in numpy.  Scoring is one pass without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanescope.llm import arrays

GOOD, BAD, ABSTAIN = 1, 0, 2
#: The bound of the sample that trains the scorer, by least hash of the id.
MAX_SAMPLE = 6000
TABLE = 1 << 16
ROUNDS, EPOCHS, RATE, BATCH = 200, 6, 0.5, 64
#: Least and greatest prior of a bad text: an assumption that tells the two classes apart.
PRIOR_BAD = (0.005, 0.5)
#: A bad vote is taken to be so many times as likely on bad texts as on good ones, at least.
LEAST_RATIO = 10.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LATIN = np.zeros(256, bool)
_LATIN[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in ".,;:'\"()-?"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(x) for x in ".?!"]] = True

#: Shape of a byte: one letter for each class of letters, one digit, signs as they are.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("9")
_SHAPE[0x80:] = ord("a")


@dataclass
class Words:
    """Bytes, words and their hashes of a slice of texts."""

    body: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    same: np.ndarray  # whether a word repeats the one before it in its text

    @classmethod
    def of(cls, body: np.ndarray, offsets: np.ndarray) -> Words:
        starts, ends, first = arrays.word_bounds(body, offsets, arrays.SPACES)
        hashes = arrays.word_hashes(body, starts, ends)
        same = np.zeros(len(hashes), bool)
        same[1:] = hashes[1:] == hashes[:-1]
        same[first[:-1][first[:-1] < len(same)]] = False
        return cls(body, offsets, starts, ends, first, hashes, same)

    def share(self, flags: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        """Share of flagged bytes (among those of ``of``) in each text; nan without any."""
        return _ratio(_sums(flags, self.offsets), _sums(np.ones(len(flags), bool) if of is None else of, self.offsets))

    def word_share(self, flags: np.ndarray) -> np.ndarray:
        return _ratio(_sums(flags, self.first), np.diff(self.first))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[offsets])


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(b > 0, a / b, np.nan)


def _vote(value: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(value), ABSTAIN, np.where(bad, BAD, np.where(good, GOOD, ABSTAIN)))


def _below(value: np.ndarray, good: float, bad: float) -> np.ndarray:
    return _vote(value, value <= good, value >= bad)


def signs(w: Words) -> np.ndarray:
    return _below(w.share(_SIGN[w.body]), 0.01, 0.06)


def capitals(w: Words) -> np.ndarray:
    return _below(w.share(_UPPER[w.body], _LATIN[w.body]), 0.15, 0.5)


def repeats(w: Words) -> np.ndarray:
    return _below(w.word_share(w.same), 0.05, 0.25)


def runs(w: Words) -> np.ndarray:
    """Share of words that repeat both of the two before them."""
    twice = w.same.copy()
    twice[1:] &= w.same[:-1]
    return _below(w.word_share(twice), 0.01, 0.15)


def variety(w: Words) -> np.ndarray:
    """Different words of every fifty in a row, on average."""
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    place = (np.arange(len(text)) - w.first[text]) // 50
    block = arrays.mix(text.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64))
    chosen, _ = arrays.distinct(arrays.mix(w.hashes ^ block))
    fresh = np.zeros(len(text), bool)
    fresh[chosen] = True
    value = w.word_share(fresh)
    return _vote(value, value >= 0.5, value <= 0.35)


def wordless(w: Words) -> np.ndarray:
    """Share of words without any letter."""
    letters = np.concatenate([[0], np.cumsum(_LETTER[w.body])])
    return _below(w.word_share(letters[w.ends] == letters[w.starts]), 0.05, 0.25)


def endings(w: Words) -> np.ndarray:
    """Share of words that end in a sign no sentence ends with, or in more than one."""
    last = w.body[w.ends - 1] if len(w.ends) else w.body[:0]
    before = w.body[np.maximum(w.ends - 2, 0)] if len(w.ends) else w.body[:0]
    odd = _SIGN[last] | (_STOP[last] & _STOP[before] & (w.ends - w.starts > 1))
    return _below(w.word_share(odd), 0.02, 0.2)


def sentences(w: Words) -> np.ndarray:
    """Words per full stop: too many without one are a list, not prose."""
    last = w.body[w.ends - 1] if len(w.ends) else w.body[:0]
    value = _ratio(np.diff(w.first), _sums(last == ord("."), w.first) + 0.5)
    return _vote(value, (value >= 3) & (value <= 40), value > 80)


def word_lengths(w: Words) -> np.ndarray:
    value = _ratio(_sums(w.ends - w.starts, w.first), np.diff(w.first))
    return _vote(value, (value >= 3) & (value <= 9), (value < 2) | (value > 14))


LABELLERS = (signs, capitals, repeats, runs, variety, wordless, endings, sentences, word_lengths)


def votes(words: Words) -> np.ndarray:
    """One number per text: its votes as digits to the base three."""
    pattern = np.zeros(len(words.offsets) - 1, np.int64)
    for labeller in LABELLERS:
        pattern = 3 * pattern + labeller(words).astype(np.int64)
    return pattern


def digits(patterns: np.ndarray) -> np.ndarray:
    """Votes of each pattern: (patterns, labellers)."""
    powers = 3 ** np.arange(len(LABELLERS) - 1, -1, -1)
    return patterns[:, None] // powers % 3


@dataclass
class LabelModel:
    """chance[class, labeller, vote], class 0 bad, 1 good; ``prior`` of a good text."""

    chance: np.ndarray
    prior: float

    @classmethod
    def fitted(cls, patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
        """Estimated by expectation-maximisation from the counts of all patterns.

        It begins with the share of good votes, and classes stay apart because a labeller is taken
        to vote bad on bad texts rather than on good ones.
        """
        given = digits(patterns)
        cast = (given != ABSTAIN).sum(axis=1)
        good = (given == GOOD).sum(axis=1)
        posterior = np.where((given == BAD).any(axis=1), 0.1, np.where(good > cast / 2, 0.95, 0.5))
        model = cls(np.full((2, len(LABELLERS), 3), 1 / 3), 0.9)
        for _ in range(ROUNDS if counts.sum() else 0):
            chance = np.empty_like(model.chance)
            for kind, weight in ((0, (1 - posterior) * counts), (1, posterior * counts)):
                for vote in range(3):
                    chance[kind, :, vote] = (weight[:, None] * (given == vote)).sum(axis=0) + 0.1
            chance /= chance.sum(axis=2, keepdims=True)
            chance[1, :, BAD] = np.minimum(chance[1, :, BAD], chance[0, :, BAD] / LEAST_RATIO)
            chance /= chance.sum(axis=2, keepdims=True)
            prior = 1 - np.clip(((1 - posterior) * counts).sum() / counts.sum(), *PRIOR_BAD)
            model = cls(chance, float(prior))
            now = model.posterior(patterns)
            if np.abs(now - posterior).max() < 1e-9:
                break
            posterior = now
        return model

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes is good."""
        given = digits(patterns)
        logs = [np.log(self.chance[k][np.arange(len(LABELLERS)), given]).sum(axis=1) for k in (0, 1)]
        odds = logs[1] - logs[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def accuracies(self) -> dict[str, float]:
        """Of each labeller, when it votes: how often it is right."""
        right = self.prior * self.chance[1, :, GOOD] + (1 - self.prior) * self.chance[0, :, BAD]
        wrong = self.prior * self.chance[1, :, BAD] + (1 - self.prior) * self.chance[0, :, GOOD]
        return {f.__name__: float(r / (r + x)) for f, r, x in zip(LABELLERS, right, wrong)}


def features(words: Words) -> np.ndarray:
    """Rows of the scorer's table for each word: its shape, and its shape with the one before."""
    shape = _SHAPE[words.body]
    kept = np.ones(len(shape), bool)
    kept[1:] = shape[1:] != shape[:-1]
    kept[words.starts] = True
    at = np.concatenate([[0], np.cumsum(kept)])
    hashes = arrays.word_hashes(shape[kept], at[words.starts], at[words.ends])
    hashes = np.where(words.same, arrays.mix(np.uint64(1) + words.same), hashes)
    before = np.roll(hashes, 1)
    begin = words.first[:-1][np.diff(words.first) > 0]
    before[begin] = 0
    pairs = arrays.mix(hashes ^ arrays.mix(before + np.uint64(3)))
    size = np.uint64(TABLE)
    return np.stack([hashes % size, pairs % size], axis=1).astype(np.int64)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def scores(self, words: Words) -> np.ndarray:
        counts = np.diff(words.first)
        text = np.repeat(np.arange(len(counts)), counts)
        # Added up text by text, so that neighbours don't change a rounding.
        total = np.bincount(text, self.weights[features(words)].sum(axis=1), len(counts))
        logits = np.where(counts > 0, total / np.maximum(counts, 1), 0) + self.bias
        return np.where(counts > 0, 1 / (1 + np.exp(-np.clip(logits, -30, 30))), 0.0)

    @classmethod
    def trained(cls, words: Words, labels: np.ndarray, seed: int = 3) -> Scorer:
        """Logistic regression on mean features, labels being probabilities."""
        random, rows = np.random.default_rng(seed), features(words)
        weights, seen, bias = np.zeros(TABLE), np.full(TABLE, 1e-8), 0.0
        counts = np.diff(words.first)
        usable = np.flatnonzero(counts)
        for _ in range(EPOCHS):
            order = random.permutation(usable)
            for at in range(0, len(order), BATCH):
                chosen = order[at : at + BATCH]
                n = counts[chosen]
                own = rows[arrays.ranges(words.first[chosen], n)]
                text = np.repeat(np.arange(len(chosen)), n)
                part = 1 / n[text]
                logits = np.bincount(text, weights[own].sum(axis=1) * part, len(chosen)) + bias
                error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels[chosen]) / len(chosen)
                slope = np.bincount(own.reshape(-1), np.repeat(error[text] * part, 2), TABLE)
                seen += slope * slope
                weights -= RATE * slope / np.sqrt(seen)
                bias -= RATE * error.sum()
        return cls(weights, float(bias))


def _pattern_counts(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.pieces(batches, text):
            found = votes(Words.of(*arrays.text_bytes(batch.column(text))))
            yield pa.RecordBatch.from_arrays([pa.array(found)], names=["pattern"])

    counted = docs.select(text).mapInArrow(run, "pattern long").groupBy("pattern").count()
    rows = counted.collect()  # 3 to the number of labellers at most, 19683
    return np.array([r["pattern"] for r in rows], np.int64), np.array([r["count"] for r in rows], float)


def fit(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> tuple[LabelModel, Scorer]:
    """The label model over all of ``docs``, and a scorer trained on a sample of MAX_SAMPLE of them."""
    labels = LabelModel.fitted(*_pattern_counts(docs, text))
    rows = sample(docs, text, id_column)
    if not rows.num_rows:
        return labels, Scorer(np.zeros(TABLE), 0.0)
    words = Words.of(*arrays.text_bytes(rows.column("text").combine_chunks()))
    return labels, Scorer.trained(words, labels.posterior(votes(words)))


def sample(docs: DataFrame, text: str, id_column: str) -> pa.Table:
    """One row, the text of least hash, of each of MAX_SAMPLE ids at most."""
    chosen = docs.select(F.col(id_column).alias("__id")).distinct()
    chosen = chosen.orderBy(F.xxhash64(F.col("__id").cast("string")), "__id").limit(MAX_SAMPLE)
    given = docs.select(F.col(id_column).alias("__id"), F.coalesce(text, F.lit("")).alias("text"))
    # Bounded by the limit: six thousand ids.
    found = given.join(F.broadcast(chosen), "__id", "left_semi").groupBy("__id").agg(
        F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")
    )
    rows = found.select("__id", "first.text").toArrow().combine_chunks()
    return rows.sort_by([("__id", "ascending")])


ADDED = T.StructType([
    T.StructField("votes", T.ArrayType(T.IntegerType())),
    T.StructField("posterior", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("predicted", T.IntegerType()),
])


def classified(docs: DataFrame, text: str = "text", id_column: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or ``keep`` of it) with votes, posterior, score and predicted (1: good).

    ``votes`` has one entry per labeller; ``posterior`` is the label model's probability of a good
    text, ``score`` the scorer's.  Texts without words, and nulls, score 0.  Repeated rows are each
    counted and scored; an empty table gives an empty table; clashing columns are replaced.
    """
    labels, scorer = fit(docs, text, id_column)
    names = [c for c in (keep or docs.columns) if c not in ADDED.names]
    frame = docs.select(*dict.fromkeys([*names, text]))
    schema = T.StructType([frame.schema[c] for c in names] + ADDED.fields)
    shared = docs.sparkSession.sparkContext.broadcast((labels, scorer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, scorer = shared.value
        for batch in arrays.pieces(batches, text):
            words = Words.of(*arrays.text_bytes(batch.column(text)))
            patterns, scores = votes(words), scorer.scores(words)
            columns = [batch.column(c) for c in names] + [
                pa.array(digits(patterns).tolist(), pa.list_(pa.int32())),
                pa.array(labels.posterior(patterns), pa.float64()),
                pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return frame.mapInArrow(run, schema)
