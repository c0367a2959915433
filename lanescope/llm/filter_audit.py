"""Filter interaction audit: what each filter removes in every order of application.

A document is reduced to a mask of the filters it fails; documents of one part (source) with equal
masks form a cell, so at most 32 weighted cells a part leave the map side, however many documents it
has.  Each cell is then folded across the constant array of all 120 orders with higher-order
functions: ``transform`` over the orders, ``aggregate`` over the steps of one, which gives 600
weighted structs, and the cells of a part are merged by elementwise sums.  Everything is built-in
expressions; no document or order passes through the driver.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LETTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT = 65  # distinct words in a hundred
MAX_UPPER = 5  # capital letters in a hundred characters
SIGNS = "[#$%&*|]"
#: Salts that spread rows without an id over the label join.
SALTS = 1024

SUMS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def checked(docs: DataFrame, text: str, id_column: str, part: str) -> DataFrame:
    """One narrow row per document: id, part, digest of the text and mask of filters A to D."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("body"),
        F.array_remove(F.split(body, r"[\x20\x09-\x0D]+"), "").alias("words"),
    )
    words, capitals = F.size("words"), F.length("body") - F.length(
        F.regexp_replace("body", "[A-Z]+", "")
    )
    fails = [
        words < MIN_WORDS,
        100 * F.size(F.array_distinct("words")) < MIN_DISTINCT * words,
        100 * capitals.cast("long") > MAX_UPPER * F.length("body").cast("long"),
        F.col("body").rlike(SIGNS),
    ]
    mask = sum((fail.cast("int") * (1 << bit) for bit, fail in enumerate(fails)), F.lit(0))
    return rows.select("id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), mask.alias("mask"))


def cells(
    docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id",
    part: str = "source",
) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, E included.

    Copies are first counted by (id, text), then by text and part, so a text that a third of all
    rows share is a few rows when its least id is looked up.
    """
    copies = 1 << LETTERS.index("E")
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(0)
    rows = (
        checked(docs, text, id_column, part).groupBy("id", "part", "digest", "mask")
        .agg(F.count("*").alias("n")).withColumn("salt", salt.cast("int"))
    )
    marks = labels.where(F.col(id_column).isNotNull()).groupBy(
        F.col(id_column).cast("long").alias("id"), F.lit(0).alias("salt")
    ).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    texts = (
        rows.join(marks, ["id", "salt"], "left")
        .groupBy("digest", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"),
                 F.coalesce("toxic", F.lit(False)).alias("toxic"))
        .agg(
            F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"),
            F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
        )
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    own = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    halves = F.explode(F.array(
        F.struct(F.col("mask").alias("m"), F.col("own").alias("k")),
        F.struct(F.col("mask").bitwiseOR(copies).alias("m"), (F.col("n") - F.col("own")).alias("k")),
    ))
    return (
        texts.withColumn("first", first).withColumn("own", own)
        .select("part", "good", "toxic", halves.alias("half")).where("half.k > 0")
        .groupBy("part", F.col("half.m").alias("mask"))
        .agg(
            F.sum("half.k").alias("n"),
            F.sum(F.when(F.col("good"), F.col("half.k")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), F.col("half.k")).otherwise(0)).alias("toxic"),
        )
    )


def _orders() -> Column:
    """The constant array of all orders, each a list of filter bits."""
    return F.array(*[
        F.array(*[F.lit(1 << LETTERS.index(letter)) for letter in order])
        for order in permutations(LETTERS)
    ])


def _slots() -> Column:
    """Order, step and filter of each of the 600 structs."""
    return F.array(*[
        F.struct(
            F.lit("".join(order)).alias("filter_order"), F.lit(step).alias("step"),
            F.lit(LETTERS.index(letter)).alias("filter"),
        )
        for order in permutations(LETTERS) for step, letter in enumerate(order, 1)
    ])


def _struct(values: dict[str, Column]) -> Column:
    return F.struct(*[value.cast("long").alias(name) for name, value in values.items()])


def _folded(cell: Column) -> Column:
    """The 600 weighted structs of one cell."""
    nothing = F.lit(0).cast("long")

    def step(state: Column, bit: Column) -> Column:
        fails, gone = cell["mask"].bitwiseAND(bit) != 0, state["gone"]
        falls = fails & ~gone
        weigh = {
            "kept": (~fails & ~gone, "n"), "removed": (falls, "n"), "redundant": (fails & gone, "n"),
            "unique_fails": (cell["mask"] == bit, "n"), "good_lost": (falls, "good"),
            "toxic_lost": (falls, "toxic"),
        }
        row = _struct({
            name: F.when(there, cell[weight]).otherwise(nothing)
            for name, (there, weight) in weigh.items()
        })
        return F.struct((fails | gone).alias("gone"), F.concat(state["rows"], F.array(row)).alias("rows"))

    zero = F.array(_struct({name: nothing for name in SUMS}))
    start = F.struct(F.lit(False).alias("gone"), F.slice(zero, 1, 0).alias("rows"))
    return F.flatten(F.transform(
        _orders(), lambda bits: F.aggregate(bits, start, step, lambda state: state["rows"])
    ))


def folded(counted: DataFrame) -> DataFrame:
    """Cells of each part to its 600 rows; ``shapley`` adds a filter's removals over all orders."""
    zero = _struct({name: F.lit(0) for name in SUMS})
    size = len(LETTERS) * len(list(permutations(LETTERS)))

    def add(left: Column, right: Column) -> Column:
        return _struct({name: left[name] + right[name] for name in SUMS})

    merged = F.aggregate(
        "cells", F.array_repeat(zero, size),
        lambda total, cell: F.zip_with(total, _folded(cell), add),
    )
    # At most one cell for each of the 32 masks.
    parts = counted.groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")
    ).select("part", merged.alias("sums"))
    joined = F.zip_with(
        _slots(), "sums", lambda slot, sums: F.struct(slot.alias("slot"), sums.alias("sums"))
    )

    def removed_by(number: int) -> Column:
        def step(total: Column, row: Column) -> Column:
            own = row["slot"]["filter"] == number
            return total + F.when(own, row["sums"]["removed"]).otherwise(0)

        return F.aggregate("rows", F.lit(0).cast("long"), step)

    shapley = F.array(*[removed_by(number) for number in range(len(LETTERS))])
    return (
        parts.select("part", joined.alias("rows"))
        .select("part", "rows", shapley.alias("shapley"))
        .select("part", "shapley", F.explode("rows").alias("row"))
        .select(
            "part", "row.slot.filter_order", "row.slot.step", "row.sums.*",
            F.get("shapley", F.col("row.slot.filter")).alias("shapley"),
        )
    )


def audit(
    docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id",
    part: str = "source",
) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    A fails texts of fewer than 50 words, B those with under 65 distinct words in a hundred, C those
    with more than 5 capitals A-Z in a hundred characters, D those with a sign of ``#$%&*|``, E those
    identical to the text of a smaller id anywhere in the table, removed or not.  A null text is
    empty, a null part the empty string.  Rows that repeat an id are documents of their own, none a
    copy of the other through its id; a row without an id is never a copy, nor the original of one.
    Of several labels of an id, any quality 1 and any toxic 1 counts.  Without documents there are
    no rows.  Columns besides the named ones are ignored.
    """
    return folded(cells(docs, labels, text, id_column, part))
