"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of the embeddings of its hash and of the hashes of its first 3 to 8
bytes, so that inflected forms share what they begin with.  Filters of width 1, 2 and 3 slide over the
words, each is max-pooled over the whole text, and one linear layer gives the score.

Training takes every labelled text that may be learnt from.  They are dealt to shards of bounded size
by a hash of their id, and a shard is split into words once and written.  In each of ``ROUNDS``
rounds, every shard continues from the same model with ``PASSES`` passes over its own texts, and the
models are averaged in Spark: a row of the table over the shards that moved it, so that a rare word
learns as fast as in one shard alone, all else weighted by the shards' texts.  Only the pooled
positions have gradients, which makes a step cheap whatever a text's length.  The driver sees the
averaged model alone, which has a fixed size.

Scoring broadcasts the model (``TABLE`` rows, a few MB) and multiplies filters with each different
word of a slice once; the rest is gathering and maxima.  No row leaves its partition.

The decision threshold is calibrated by language on the sixth of those texts that training doesn't
see, all of them counted by the log odds of their score; the score itself never looks at the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanescope.llm import arrays
from lanescope.llm.shared import release, released, written

TABLE, WIDTH, FILTERS, SPANS = 1 << 17, 8, 8, (1, 2, 3)
PREFIXES = (3, 4, 5, 6, 7, 8)
#: The bound of ``sample``: so many texts of either label.
MAX_TOXIC, MAX_OTHER = 3000, 5000
#: Features in fewer training texts have no embedding: they could only be learnt by heart.
MIN_TEXTS = 3
#: Passes over the training texts: so many in each round, after which the shards' models are averaged.
ROUNDS, PASSES = 4, 2
EPOCHS, BATCH, RATE = ROUNDS * PASSES, 32, 0.15
#: A shard has so many labelled texts, and texts of so many bytes, at most about; there are up to
#: FEW_SHARDS as soon as each has LEAST_TEXTS, so that few texts keep several cores busy.
SHARD_TEXTS, SHARD_BYTES, LEAST_TEXTS, FEW_SHARDS = 8000, 64_000_000, 1000, 16
#: Bits of the map of labelled ids.
SLOTS = 1 << 24
#: Rows of the table that are averaged together.
BLOCK_ROWS = 2048
#: Share of words that a training step passes over, so that no word hides the others of its text.
DROPPED = 0.4
#: One labelled text in so many calibrates thresholds.
HELD_BACK = 6
#: Log odds are counted in steps of one in so many.
STEPS = 1000
DEFAULT_THRESHOLD = 0.7
SCORE_AT = 0.7


def _lowered(body: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the accented capitals of Latin-1."""
    body = arrays.lower(body).copy()
    capital = np.flatnonzero((body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97) & (body[:-1] == 0xC3))
    body[capital + 1] += 0x20
    return body


def words_of(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each different word, each word's place among them, first word of each text."""
    body = _lowered(body)
    starts, ends, first = arrays.word_bounds(body, offsets, arrays.SYMBOLS)
    hashes = arrays.word_hashes(body, starts, ends)
    chosen, places = arrays.distinct(hashes)
    eight = arrays.eight_bytes(body)[starts[chosen]]
    size = (ends - starts)[chosen]
    features = np.zeros((len(chosen), 1 + len(PREFIXES)), np.int64)  # row 0 of the table stays zero
    features[:, 0] = 1 + (hashes[chosen] % np.uint64(TABLE - 1)).astype(np.int64)
    for column, n in enumerate(PREFIXES, 1):
        seed = np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))
        prefix = arrays.mix((eight & arrays._KEEP[n]) ^ seed)
        number = 1 + (prefix % np.uint64(TABLE - 1)).astype(np.int64)
        features[:, column] = np.where(size >= n, number, 0)
    return features, places, first


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, WIDTH, FILTERS)
    shifts: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, features: np.ndarray, places: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Maximum of each filter over each text; zero for texts without words."""
        texts = len(first) - 1
        words = self.table[features].sum(axis=1)
        words = np.concatenate([words, np.zeros((1, WIDTH), np.float32)])  # the last one is no word
        counts = np.diff(first)
        last = np.repeat(first[1:], counts) if len(places) else places
        at = np.arange(len(places))
        found = np.zeros((texts, len(SPANS) * FILTERS), np.float32)
        filled = np.flatnonzero(counts)
        if not len(filled):
            return found
        for i, span in enumerate(SPANS):
            total = np.broadcast_to(self.shifts[i], (len(places), FILTERS)).copy()
            for step in range(span):
                product = words @ self.filters[i][step]
                if step == 0:
                    total += product[places]
                else:
                    there = at + step < last
                    here = np.full(len(places), len(words) - 1)
                    here[there] = places[np.flatnonzero(there) + step]
                    total += product[here]
            found[filled, i * FILTERS : (i + 1) * FILTERS] = np.maximum.reduceat(
                total, first[filled], axis=0
            )
        return np.maximum(found, 0)

    def odds(self, features: np.ndarray, places: np.ndarray, first: np.ndarray) -> np.ndarray:
        logits = self.pooled(features, places, first) @ self.weights + self.bias
        return np.clip(logits.astype(np.float64), -30, 30)

    def scores(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.odds(*words_of(body, offsets))))


class _Adagrad:
    def __init__(self, shape) -> None:
        self.seen = np.full(shape, 1e-6, np.float32)

    def step(self, value: np.ndarray, slope: np.ndarray, rows=slice(None)) -> None:
        self.seen[rows] += slope * slope
        value[rows] -= RATE * slope / np.sqrt(self.seen[rows])


@dataclass
class _Training:
    """A model in training, with the sums of squares that set its rates."""

    model: Model
    bias: np.ndarray
    slopes: dict[str, _Adagrad]
    own: list[tuple[_Adagrad, _Adagrad]]  # of the filters and shifts of each width

    @classmethod
    def start(cls, kept: np.ndarray, seed: int) -> _Training:
        """``kept`` says which rows of the table are learnt; the others stay zero."""
        random = np.random.default_rng(seed)
        table = random.normal(0, 0.1, (TABLE, WIDTH)).astype(np.float32)
        table[~kept] = 0
        filters = [random.normal(0, 0.4, (s, WIDTH, FILTERS)).astype(np.float32) for s in SPANS]
        shifts = [np.full(FILTERS, 0.1, np.float32) for _ in SPANS]
        weights = random.normal(0, 0.5, len(SPANS) * FILTERS).astype(np.float32)
        slopes = {"table": _Adagrad(table.shape), "weights": _Adagrad(weights.shape), "bias": _Adagrad(1)}
        own = [(_Adagrad(f.shape), _Adagrad(s.shape)) for f, s in zip(filters, shifts)]
        return cls(Model(table, filters, shifts, weights, 0.0), np.zeros(1, np.float32), slopes, own)

    def passes(self, n: int, features, places, first, labels, random) -> None:
        for _ in range(n):
            order = random.permutation(len(labels))
            for start in range(0, len(order), BATCH):
                chosen = order[start : start + BATCH]
                _step(self.model, self.bias, chosen, features, places, first, labels, self.slopes, self.own, random)

    def dense(self) -> list[np.ndarray]:
        """All but the table, in a fixed order."""
        model = self.model
        values = [*model.filters, *model.shifts, model.weights, self.bias]
        seen = [x.seen for pair in self.own for x in pair]
        return [*values, *seen, self.slopes["weights"].seen, self.slopes["bias"].seen]

    def done(self) -> Model:
        self.model.bias = float(self.bias[0])
        return self.model


def train(texts: pa.Array, labels: np.ndarray, seed: int = 7) -> Model:
    """A model of the texts and their labels (0 or 1), trained here as one shard of all of them.

    Without texts of both labels it scores 0.5.
    """
    features, places, first = words_of(*arrays.text_bytes(texts))
    kept = _texts_with(features, places, first) >= MIN_TEXTS
    training = _Training.start(kept, seed)
    if len(np.unique(labels)) < 2:
        training.model.weights[:] = 0
        return training.done()
    features = np.where(kept[features], features, 0)
    training.passes(EPOCHS, features, places, first, labels, np.random.default_rng([seed, 0]))
    return training.done()


def _texts_with(features: np.ndarray, places: np.ndarray, first: np.ndarray) -> np.ndarray:
    """In how many texts each row of the table occurs, counted by word; 0 for row zero."""
    seen = np.zeros(len(features), np.int64)
    for begin in range(0, len(first) - 1, 500):
        own = first[begin : begin + 501]
        texts = np.repeat(np.arange(len(own) - 1), np.diff(own))
        pair = np.unique(texts * np.int64(len(features) + 1) + places[own[0] : own[-1]])  # a word once per text
        seen += np.bincount(pair % (len(features) + 1), minlength=len(features))
    counts = np.zeros(TABLE, np.int64)
    for column in features.T:
        counts += np.bincount(column, weights=seen, minlength=TABLE).astype(np.int64)
    counts[0] = 0
    return counts


def _step(model, bias, chosen, features, places, first, labels, slopes, own, random) -> None:
    lengths = first[chosen + 1] - first[chosen]
    at = arrays.ranges(first[chosen], lengths)
    used, local = np.unique(places[at], return_inverse=True)
    words = np.concatenate([model.table[features[used]].sum(axis=1), np.zeros((1, WIDTH), np.float32)])
    none = len(used)
    ends = np.cumsum(lengths)
    local[random.random(len(local)) < DROPPED] = none
    local = np.concatenate([local, np.full(max(SPANS), none)])
    pooled = np.zeros((len(chosen), len(SPANS) * FILTERS), np.float32)
    where = np.zeros(pooled.shape, np.int64)
    after = np.repeat(ends, lengths)
    index = np.arange(len(at))
    for i, span in enumerate(SPANS):
        total = model.shifts[i] + (words @ model.filters[i][0])[local[: len(at)]]
        for step in range(1, span):
            here = np.where(index + step < after, local[step : step + len(at)], none)
            total += (words @ model.filters[i][step])[here]
        columns = slice(i * FILTERS, (i + 1) * FILTERS)
        for row, (end, n) in enumerate(zip(ends.tolist(), lengths.tolist())):
            if n:
                best = total[end - n : end].argmax(axis=0)
                where[row, columns] = best + end - n
                pooled[row, columns] = total[best + end - n, np.arange(FILTERS)]
    active = (pooled > 0) & (lengths > 0)[:, None]
    pooled *= active
    logits = pooled @ model.weights + bias[0]
    error = ((1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels[chosen]) / len(chosen)).astype(np.float32)
    back = error[:, None] * model.weights * active
    slopes["weights"].step(model.weights, error @ pooled)
    slopes["bias"].step(bias, error.sum(keepdims=True))
    slope_words = np.zeros_like(words)
    for i, span in enumerate(SPANS):
        columns = slice(i * FILTERS, (i + 1) * FILTERS)
        g, place = back[:, columns], where[:, columns]
        slope = np.zeros_like(model.filters[i])
        for step in range(span):
            inside = place + step < ends[:, None]
            word = np.where(inside, local[np.minimum(place + step, len(local) - 1)], none)
            slope[step] = np.einsum("kf,kfd->df", g, words[word])
            np.add.at(slope_words, word, g[..., None] * model.filters[i][step].T[None])
        own[i][0].step(model.filters[i], slope)
        own[i][1].step(model.shifts[i], g.sum(axis=0))
    moved = np.flatnonzero(np.abs(slope_words[:none]).sum(axis=1))
    rows = features[used[moved]]
    flat, inverse = np.unique(rows, return_inverse=True)
    slope = np.zeros((len(flat), WIDTH), np.float32)
    np.add.at(slope, inverse.reshape(rows.shape), slope_words[moved][:, None, :])
    real = flat > 0
    slopes["table"].step(model.table, slope[real], flat[real])


def _threshold(low: np.ndarray, high: np.ndarray, toxic: np.ndarray, other: np.ndarray) -> float:
    """Middle of the gap, in log odds, between what is kept and what is rejected with fewest errors.

    ``low`` and ``high`` are the ends of ascending steps of log odds, with their texts of either label.
    """
    wrong = np.concatenate([[0], np.cumsum(toxic)]) + other.sum() - np.concatenate([[0], np.cumsum(other)])
    above, below = np.concatenate([low, high[-1:] + 4]), np.concatenate([low[:1] - 4, high])
    best = np.flatnonzero(wrong == wrong.min())
    cut = best[np.argmax((above - below)[best])]
    middle = (above[cut] + below[cut]) / 2
    return float(np.clip(1 / (1 + np.exp(-middle)), 0.3, 0.9))


def learnable(id_column: Column) -> Column:
    """Rows that labels may be learnt from."""
    return F.crc32(id_column.cast("string").cast("binary")) % 3 != 1


def labelled(docs: DataFrame, labels: DataFrame, shards: int = 1) -> DataFrame:
    """(shard, back, doc_id, text, lang, toxic) of every labelled row that may be learnt from.

    One row of each id, with its text of least hash; toxic if any of its labels says so.  ``back``
    marks what calibrates thresholds.  Texts are moved once, to their shard.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & learnable(F.col("doc_id")))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce("text", F.lit(""))
    first = F.struct(F.xxhash64("text").alias("hash"), text.alias("text"), lang.alias("lang"))
    own = _maybe_labelled(docs.where(learnable(F.col("doc_id"))), usable).select(
        "doc_id", first.alias("first"), F.lit(None).cast("int").alias("toxic")
    )
    marks = usable.select(
        "doc_id", F.lit(None).cast(own.schema["first"].dataType).alias("first"),
        F.col("toxic").cast("int").alias("toxic"),
    )
    hashed = F.xxhash64("doc_id")
    rows = own.unionByName(marks).withColumn("shard", F.pmod(hashed, F.lit(shards)).cast("int"))
    found = rows.repartition(shards, "shard").groupBy("shard", "doc_id").agg(
        F.min("first").alias("first"), F.max("toxic").alias("toxic")
    ).where("first IS NOT NULL AND toxic IS NOT NULL")
    back = F.pmod(F.xxhash64(F.lit("back"), "doc_id"), F.lit(HELD_BACK)) == 0
    return found.select("shard", back.alias("back"), "doc_id", "first.text", "first.lang", "toxic")


def _maybe_labelled(docs: DataFrame, usable: DataFrame) -> DataFrame:
    """``docs`` without most of those that have no label, so that few texts are moved for nothing.

    The hashes of labelled ids set bits of a map of fixed size; it drops no labelled row.
    """
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(SLOTS))
    place = slot.bitwiseAND(63).cast("int")
    bits = usable.select(
        F.shiftright(slot, 6).alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("__bit")
    ).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    # SLOTS / 64 rows of two numbers, at most.
    near = docs.withColumn("__word", F.shiftright(slot, 6)).join(F.broadcast(bits), "__word")
    return near.where(F.getbit("__bits", place) == 1).select(*docs.columns)


def sample(docs: DataFrame, labels: DataFrame) -> pa.Table:
    """At most MAX_TOXIC and MAX_OTHER of the training rows, to look at; ``fit`` learns from all."""
    rows = labelled(docs, labels).drop("shard", "back")
    order = F.xxhash64("doc_id")
    found = rows.where("toxic = 1").orderBy(order, "doc_id").limit(MAX_TOXIC).unionByName(
        rows.where("toxic = 0").orderBy(order, "doc_id").limit(MAX_OTHER)
    )
    return found.toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])


_FACTORS = arrays.mix(np.arange(1, 2 + len(PREFIXES), dtype=np.uint64)) | np.uint64(1)
PACKED = (
    "shard int, back boolean, n long, n_toxic long, toxic binary, langs array<string>, "
    "features binary, places binary, first binary"
)


def _pack(table: pa.Table) -> pa.Table:
    """A shard's texts as words: one row of arrays."""
    table = table.sort_by("doc_id").combine_chunks()
    features, places, first = [np.zeros((0, 1 + len(PREFIXES)), np.int32)], [], [np.zeros(1, np.int64)]
    words = 0
    # Piece by piece, each with its own different words: splitting takes many times the bytes of a text.
    for piece in arrays.pieces(iter(table.select(["text"]).to_batches()), "text"):
        own, at, begin = words_of(*arrays.text_bytes(piece.column("text")))
        features.append(own.astype(np.int32))
        places.append((at + words).astype(np.int32))
        first.append(begin[1:] + first[-1][-1])
        words += len(own)
    features, places, first = (np.concatenate(x) for x in (features, places, first))
    chosen, again = arrays.distinct(arrays.mix(features.astype(np.uint64) @ _FACTORS))
    features, places = features[chosen], again.astype(np.int32)[places]
    toxic = table.column("toxic").to_numpy()
    columns = [
        table.column("shard")[:1], table.column("back")[:1], [len(toxic)], [int(toxic.sum())],
        [toxic.astype(np.uint8).tobytes()], pa.array([table.column("lang").to_pylist()], pa.list_(pa.string())),
        [features.tobytes()], [places.tobytes()], [first.astype(np.int64).tobytes()],
    ]
    release()
    return pa.table(columns, names=[x.split()[0] for x in PACKED.split(", ")])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(shard, features, places, first, labels, langs) of each shard."""
    for row in range(batch.num_rows):
        one = {c: batch.column(c)[row] for c in batch.schema.names}
        features = np.frombuffer(one["features"].as_buffer(), np.int32).reshape(-1, 1 + len(PREFIXES))
        places, first = (np.frombuffer(one[c].as_buffer(), kind) for c, kind in (("places", np.int32), ("first", np.int64)))
        labels = np.frombuffer(one["toxic"].as_buffer(), np.uint8).astype(np.int64)
        yield one["shard"].as_py(), features, places, first, labels, one["langs"].as_py()


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, features, places, first, _, _ in _unpacked(batch):
            counts = _texts_with(features, places, first)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["feature", "n"])


#: Moved rows of a block of the table, or all dense values (block -1), of one shard or averaged.
MOVED = "block int, shard int, n long, rows binary, values binary"


def _moved(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    names = [x.split()[0] for x in MOVED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], names=names)


def _train_shards(shared, kept: np.ndarray, seed: int, number: int):
    """Each shard's passes of a round, from the model that all have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, features, places, first, labels, _ in _unpacked(batch):
                training = deepcopy(shared.value)
                random = np.random.default_rng([seed, shard, number])
                training.passes(PASSES, np.where(kept[features], features, 0), places, first, labels, random)
                table, seen = training.model.table, training.slopes["table"].seen
                at = np.flatnonzero((seen != shared.value.slopes["table"].seen).any(axis=1))
                both = np.concatenate([table[at], seen[at]], axis=1)
                edges = np.searchsorted(at, np.arange(0, TABLE + BLOCK_ROWS, BLOCK_ROWS))
                dense = np.concatenate([x.ravel() for x in training.dense()]).astype(np.float32)
                rows = [(-1, shard, len(labels), None, dense.tobytes())]
                for block, (a, b) in enumerate(zip(edges, edges[1:])):
                    if b > a:
                        rows.append((block, shard, len(labels), at[a:b].astype(np.int32).tobytes(), both[a:b].tobytes()))
                yield _moved(rows)
                del training, table, seen, both, rows
                release()

    return run


def _average(table: pa.Table) -> pa.Table:
    """The mean of the shards' values: of each row over those that moved it, of the rest by texts."""
    table = table.sort_by("shard")
    block = table.column("block")[0].as_py()
    n, rows, values = (table.column(c).to_pylist() for c in ("n", "rows", "values"))
    if block < 0:
        mean = np.average([np.frombuffer(x, np.float32) for x in values], axis=0, weights=n)
        return pa.Table.from_batches([_moved([(block, 0, sum(n), None, mean.astype(np.float32).tobytes())])])
    total, times = np.zeros((BLOCK_ROWS, 2 * WIDTH)), np.zeros(BLOCK_ROWS, np.int64)
    for at, x in zip(rows, values):
        at = np.frombuffer(at, np.int32) - block * BLOCK_ROWS
        total[at] += np.frombuffer(x, np.float32).reshape(-1, 2 * WIDTH)
        times[at] += 1
    at = np.flatnonzero(times)
    mean = (total[at] / times[at, None]).astype(np.float32)
    at = (at + block * BLOCK_ROWS).astype(np.int32)
    return pa.Table.from_batches([_moved([(block, 0, sum(n), at.tobytes(), mean.tobytes())])])


def _take_in(training: _Training, averaged: pa.Table) -> None:
    for block, rows, values in zip(*(averaged.column(c).to_pylist() for c in ("block", "rows", "values"))):
        values = np.frombuffer(values, np.float32)
        if block >= 0:
            at = np.frombuffer(rows, np.int32)
            training.model.table[at], training.slopes["table"].seen[at] = np.split(values.reshape(-1, 2 * WIDTH), 2, axis=1)
            continue
        used = 0
        for x in training.dense():
            x[...] = values[used : used + x.size].reshape(x.shape)
            used += x.size


def _shards(docs: DataFrame, labels: DataFrame) -> int:
    texts = labels.where(F.col("toxic").isin(0, 1) & learnable(F.col("doc_id"))).count()
    # Texts without a label travel to the shards too.
    size = docs.where(learnable(F.col("doc_id"))).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-texts // SHARD_TEXTS), -(-size // SHARD_BYTES), min(FEW_SHARDS, texts // LEAST_TEXTS))


def fit(docs: DataFrame, labels: DataFrame, seed: int = 7) -> Model:
    """A model trained on all rows of ``labelled`` but those held back, which give its thresholds.

    Without texts of both labels it scores 0.5.  Equal in every run, however the rows are partitioned.
    """
    rows = labelled(docs, labels, _shards(docs, labels))
    packed = written(rows.groupBy("shard", "back").applyInArrow(_pack, PACKED))
    own = packed.where("NOT back")
    counts = own.mapInArrow(_count_texts, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    # As many rows as the table has, at most.
    kept = np.zeros(TABLE, bool)
    kept[counts.where(F.col("n") >= MIN_TEXTS).select("feature").toArrow().column(0).to_numpy()] = True
    training = _Training.start(kept, seed)
    total = own.agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("toxic")).first()
    if not 0 < (total.toxic or 0) < (total.n or 0):
        training.model.weights[:] = 0
    else:
        for number in range(ROUNDS):
            shared = docs.sparkSession.sparkContext.broadcast(training)
            moved = own.mapInArrow(_train_shards(shared, kept, seed, number), MOVED)
            averaged = moved.groupBy("block").applyInArrow(_average, MOVED).toArrow()
            shared.destroy()
            _take_in(training, averaged)
    model = training.done()
    model.thresholds = _thresholds(docs.sparkSession, packed.where("back"), model)
    release()
    return model


def _thresholds(spark: SparkSession, packed: DataFrame, model: Model) -> dict[str, float]:
    """Thresholds of the languages that have both labels among these texts, ten of either at least."""
    shared = spark.sparkContext.broadcast(model)
    names = ["lang", "step", "toxic", "other", "odds"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, features, places, first, labels, langs in _unpacked(batch):
                odds = shared.value.odds(features, places, first)
                columns = [
                    pa.array(["" if x is None else x for x in langs], pa.string()),
                    pa.array(np.floor(odds * STEPS).astype(np.int64)), pa.array(labels), pa.array(1 - labels), pa.array(odds),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    def cut(table: pa.Table) -> pa.Table:
        low, high, toxic, other = (table.sort_by("step").column(c).to_numpy() for c in ("low", "high", "toxic", "other"))
        return pa.table([table.column("lang")[:1], [_threshold(low, high, toxic, other)]], names=["lang", "threshold"])

    steps = packed.mapInArrow(run, "lang string, step long, toxic long, other long, odds double").groupBy(
        "lang", "step"
    ).agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"),
        F.min("odds").alias("low"), F.max("odds").alias("high"),
    )
    enough = steps.groupBy("lang").agg(F.least(F.sum("toxic"), F.sum("other")).alias("least")).where("least >= 10")
    # A language has as many steps as log odds have between -30 and 30, at most.
    chosen = steps.join(enough, "lang", "left_semi").groupBy("lang").applyInArrow(cut, "lang string, threshold double")
    return {r.lang: r.threshold for r in chosen.collect()}


def scored(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score`` from 0 to 1.

    Null and empty texts have the score of a text without words.  Repeated rows have equal scores; an
    empty table gives an empty table; a column named ``score`` is replaced.
    """
    names = [c for c in (keep or docs.columns) if c != "score"]
    frame = docs.select(*dict.fromkeys([*names, text]))
    schema = T.StructType([frame.schema[c] for c in names]).add("score", T.DoubleType())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.pieces(released(batches), text):
            found = shared.value.scores(*arrays.text_bytes(batch.column(text)))
            columns = [batch.column(c) for c in names] + [pa.array(found, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return frame.mapInArrow(run, schema)


def threshold(model: Model, lang: Column) -> Column:
    """The threshold of a language; DEFAULT_THRESHOLD for one that isn't calibrated, and for null."""
    chosen = F.lit(DEFAULT_THRESHOLD)
    for name, value in sorted(model.thresholds.items()):
        chosen = F.when(F.coalesce(lang, F.lit("")) == name, value).otherwise(chosen)
    return chosen


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those whose score reaches their language's threshold; columns as they were."""
    model = fit(docs, labels)
    marked = scored(docs.withColumnRenamed("score", "__kept_score"), model)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    kept = marked.where(F.col("score") < threshold(model, lang)).drop("score")
    return kept.withColumnRenamed("__kept_score", "score").select(*docs.columns)
