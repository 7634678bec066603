"""Ordered work over keys that may be very long.

A camera, a zone or a track can hold a large share of all rows, and a plain
window over such a key is one task. Here every key is cut along its order into
*stretches* (a stretch number is any column that never falls along the order,
for example ``floor(frame_idx / 20000)``). Rows are shuffled by key and stretch,
each stretch is worked on by itself, and what one stretch needs from those
before it is carried over through a table with one small row per stretch. The
results are the same as without the cut, wherever the cuts fall.

The small table is a grouping of its own with map-side combining, so the input
is read twice (the second time only the columns that are carried) and shuffled
in full once. Put ``cut_lineage`` in front where the input is costly to make.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.session import cut_lineage, release

FRAMES_PER_STRETCH = 20_000
SECONDS_PER_STRETCH = 1_200.0


def by_frames(frame_idx: Column, size: int = FRAMES_PER_STRETCH) -> Column:
    return F.floor(frame_idx / F.lit(size)).cast("long")


def by_seconds(ts: Column, size: float = SECONDS_PER_STRETCH) -> Column:
    return F.floor(ts / F.lit(float(size))).cast("long")


def _cut(df: DataFrame, stretch: Column) -> DataFrame:
    return df.withColumn("__s_stretch", stretch)


def by_key(table: DataFrame) -> DataFrame:
    """A table with a row per stretch, for a join by key.

    It grows with the recording. Its files are far smaller than its rows in memory, so the
    planner, left alone, takes it for a dimension and sends it through the driver into every task.
    """
    return table.hint("merge")


def at(order: Sequence[str]) -> Column:
    """The columns of an order as one value that sorts the same way."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], stretch: Column, into: str,
) -> DataFrame:
    """Add struct ``into``: ``values`` of the row before, by ``order`` within ``keys``; null on the first.

    Keys are not null, here and in the other functions.
    """
    cut = _cut(df, stretch)
    part = [*keys, "__s_stretch"]
    local = cut.withColumn("__s_prev", F.lag(F.struct(*values)).over(Window.partitionBy(*part).orderBy(*order)))
    ends = cut.groupBy(*part).agg(*[F.max_by(v, at(order)).alias(v) for v in values]).select(
        *part, F.struct(*values).alias("__s_end"))
    along = Window.partitionBy(*keys).orderBy("__s_stretch")
    carried = ends.select(*part, F.lag("__s_end").over(along).alias("__s_carried")).filter("__s_carried is not null")
    return (
        local.join(by_key(carried), part, "left")
        .withColumn(into, F.coalesce("__s_prev", "__s_carried"))
        .drop("__s_stretch", "__s_prev", "__s_carried")
    )


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, stretch: Column, into: str,
) -> DataFrame:
    """Add ``into``: the latest non-null ``value`` up to and including each row."""
    cut = _cut(df, stretch).withColumn("__s_value", value)
    part = [*keys, "__s_stretch"]
    upto = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumn("__s_local", F.last("__s_value", ignorenulls=True).over(upto))
    # rows without a value do not compete, but their stretch still receives the earlier one
    ends = cut.groupBy(*part).agg(
        F.max_by("__s_value", F.when(F.col("__s_value").isNotNull(), at(order))).alias("__s_end"))
    before = Window.partitionBy(*keys).orderBy("__s_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *part, F.last("__s_end", ignorenulls=True).over(before).alias("__s_carried")
    ).filter("__s_carried is not null")
    return (
        local.join(by_key(carried), part, "left")
        .withColumn(into, F.coalesce("__s_local", "__s_carried"))
        .drop("__s_stretch", "__s_value", "__s_local", "__s_carried")
    )


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, stretch: Column, into: str
) -> DataFrame:
    """Add ``into``: sum of ``amount`` up to and including each row."""
    cut = _cut(df, stretch).withColumn("__s_amount", amount)
    part = [*keys, "__s_stretch"]
    upto = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumn("__s_local", F.sum("__s_amount").over(upto))
    sums = cut.groupBy(*part).agg(F.sum("__s_amount").alias("__s_sum"))
    before = Window.partitionBy(*keys).orderBy("__s_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*part, F.coalesce(F.sum("__s_sum").over(before), F.lit(0)).alias("__s_before"))
    return (
        local.join(by_key(offsets), part)
        .withColumn(into, F.col("__s_local") + F.col("__s_before"))
        .drop("__s_stretch", "__s_amount", "__s_local", "__s_before")
    )


def running_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], stretch: Column, into: str
) -> DataFrame:
    """Add ``into``: 1, 2, 3... along ``order`` within ``keys`` (over all rows when ``keys`` is empty)."""
    return running_total(df, keys, order, F.lit(1).cast("long"), stretch, into)


def running_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, stretch: Column, into: str
) -> DataFrame:
    """Add ``into``: the largest ``value`` up to and including each row."""
    cut = _cut(df, stretch).withColumn("__s_value", value)
    part = [*keys, "__s_stretch"]
    upto = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumn("__s_local", F.max("__s_value").over(upto))
    tops = cut.groupBy(*part).agg(F.max("__s_value").alias("__s_top"))
    before = Window.partitionBy(*keys).orderBy("__s_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*part, F.max("__s_top").over(before).alias("__s_carried")).filter("__s_carried is not null")
    return (
        local.join(by_key(carried), part, "left")
        .withColumn(into, F.greatest("__s_local", "__s_carried"))
        .drop("__s_stretch", "__s_value", "__s_local", "__s_carried")
    )


def trailing_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], item: Column, length: int, stretch: Column, into: str,
) -> DataFrame:
    """Add ``into``: array of ``item`` over the last ``length`` rows up to each row, oldest first.

    Rows are shuffled once. The last ``length - 1`` rows of each stretch make a
    small table, from which a stretch gets what it needs of those before it.
    """
    cut = _cut(df, stretch).withColumn("__s_item", item)
    part = [*keys, "__s_stretch"]
    inside = Window.partitionBy(*part).orderBy(*order)
    if length < 2:
        return cut.withColumn(into, F.array("__s_item")).drop("__s_stretch", "__s_item")
    local = cut.withColumn(into, F.collect_list("__s_item").over(inside.rowsBetween(-(length - 1), Window.currentRow)))
    back = F.row_number().over(Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order]))
    tails = cut.select(*part, *order, "__s_item").withColumn("__s_back", back).filter(F.col("__s_back") < length)
    along = Window.partitionBy(*keys).orderBy("__s_stretch", *order)
    before = tails.withColumn(
        "__s_before", F.collect_list("__s_item").over(along.rowsBetween(-(length - 1), -1))
    ).withColumn("__s_from", F.lag("__s_stretch").over(along))
    carried = before.filter("__s_from < __s_stretch").select(*part, "__s_before")
    joined = local.join(by_key(carried), part, "left")
    both = F.when(F.col("__s_before").isNull(), F.col(into)).otherwise(F.concat("__s_before", into))
    last = F.slice(both, F.greatest(F.lit(1), F.size(both) - F.lit(length - 1)), F.lit(length))
    return joined.withColumn(into, F.when(F.size(into) < length, last).otherwise(F.col(into))).drop(
        "__s_stretch", "__s_item", "__s_before")


#: ``accept(last, row, m)`` says whether ``row`` is let through after ``last``. Both are looked up by column name, and
#: ``m`` is ``pyspark.sql.functions`` or ``numpy``, for functions that both have, as ``last`` and ``row`` are of either.
Accept = Callable[[object, object, object], object]


class _Rows:
    """Some rows of a batch, column by column."""

    def __init__(self, batch: pa.RecordBatch, places: np.ndarray, known: dict[str, np.ndarray]):
        self.batch, self.places, self.known = batch, places, known

    def __getitem__(self, column: str) -> np.ndarray:
        if column not in self.known:
            self.known[column] = self.batch.column(column).to_numpy(zero_copy_only=False)
        return self.known[column][self.places]


def _whole_groups(batches: Iterator[pa.RecordBatch], part: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end where a group does, with the places where groups start; rows come sorted by ``part``."""

    def starts(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        new[:1] = True
        for name in part:
            column = batch.column(name)
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        places = starts(batch)
        cut = int(places[-1])
        held = batch.slice(cut)
        if cut:
            yield batch.slice(0, cut), places[:-1]
    if held is not None:
        yield held, np.zeros(1, np.int64)


def _following(batch: pa.RecordBatch, starts: np.ndarray, accept: Accept) -> np.ndarray:
    """For each row the next one of its group that is let through after it; the number of rows where there is none."""
    n, known = batch.num_rows, {}
    ends = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    following, open_, shift = np.full(n + 1, n), np.arange(n), 1
    while True:
        open_ = open_[open_ + shift < ends[open_]]
        if not len(open_):
            return following
        hit = accept(_Rows(batch, open_, known), _Rows(batch, open_ + shift, known), np)
        following[open_[hit]] = open_[hit] + shift
        open_, shift = open_[~hit], shift + 1


def _with_exits(part: Sequence[str], accept: Accept):
    """Adds each row's place in its group, and the place where a chain that begins with the row leaves the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _whole_groups(batches, part):
            n = batch.num_rows
            jump = _following(batch, starts, accept)[:n]
            jump = np.where(jump < n, jump, np.arange(n))
            while True:
                further = jump[jump]
                if (further == jump).all():
                    break
                jump = further
            first = np.repeat(starts, np.diff(np.r_[starts, n]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.arange(n) - first, pa.int32()), pa.array(jump - first, pa.int32())],
                names=[*batch.schema.names, "__at", "__exit"])

    return run


def _on_chains(part: Sequence[str], accept: Accept):
    """Of each group the rows on the chain that begins at the place ``__begin``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _whole_groups(batches, part):
            n = batch.num_rows
            jump = _following(batch, starts, accept)
            taken = np.zeros(n + 1, bool)
            taken[starts + batch.column("__begin").to_numpy()[starts]] = True
            while (jump[:n] < n).any():
                taken[jump[np.flatnonzero(taken)]] = True
                jump = jump[jump]
            yield batch.filter(pa.array(taken[:n])).drop_columns(["__begin"])

    return run


def _types(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def accepted_rows(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str],
    stretch: Column, accept: Accept,
) -> DataFrame:
    """Rows that a rule lets through, where the rule looks at the last row let through.

    The first row of a key is taken; a later one if ``accept(last_taken, row, m)``.
    Which row follows one that is taken depends on that row alone, so rows point
    to their next ones, and those let through lie on one chain from the key's first.

    A stretch must hold a bounded number of rows, which the caller sees to. Within
    stretches all chains are followed at once, to the row where each leaves. From
    these rows one looks ahead into the stretches behind for the row that comes
    next, as far as the rule reaches back (one stretch or two unless stretches are
    shorter than that). So the chain is a path from stretch to stretch, and is
    followed in steps that double: rounds grow with the logarithm of the number of
    stretches, however the cuts fall and however long a chain goes on. Two written
    tables stay behind the result, all others are deleted.
    """
    part, item = [*keys, "__s_stretch"], [*order, *payload]

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition(*part).sortWithinPartitions(*part, *item)

    cut = _cut(rows, stretch).select(*part, *item)
    ddl = _types(cut, [*part, *item])
    pieces = cut_lineage(in_order(cut).mapInArrow(_with_exits(part, accept), f"{ddl}, __at int, __exit int"))
    along = Window.partitionBy(*keys).orderBy("__s_stretch")
    spans = cut_lineage(pieces.groupBy(*part).agg(F.min_by("__exit", "__at").alias("__exit")).select(
        *part, "__exit", F.lead("__s_stretch").over(along).alias("__after"), F.row_number().over(along).alias("__nth")), narrow=True)
    steps, done = _next_stretches(pieces, spans, keys, item, accept)
    most = spans.agg(F.max("__nth")).first()[0] or 1
    begins = _begins(steps, spans, keys, most)
    release(spans, *done)
    marked = pieces.join(by_key(begins), part)
    return in_order(marked.select(*part, *item, "__begin")).mapInArrow(_on_chains(part, accept), ddl).drop("__s_stretch")


def _next_stretches(
    pieces: DataFrame, spans: DataFrame, keys: Sequence[str], item: Sequence[str], accept: Accept,
) -> tuple[DataFrame, list[DataFrame]]:
    """Where chains go on: each row that one leaves a stretch from, with the stretch, place and exit of the next row."""
    last, row = F.struct(*item), F.struct(*[F.col(f"__j_{c}").alias(c) for c in item])
    ahead = pieces.select(
        *keys, F.col("__s_stretch").alias("__look"), F.struct("__at", "__exit").alias("__to"),
        *[F.col(c).alias(f"__j_{c}") for c in item])
    after = spans.select(*keys, F.col("__s_stretch").alias("__look"), F.col("__after").alias("__then"))
    left = pieces.filter("__at = __exit").join(by_key(spans.select(*keys, "__s_stretch", "__after")), [*keys, "__s_stretch"])
    open_ = left.filter("__after is not null").select(*keys, "__s_stretch", *item, "__exit", F.col("__after").alias("__look"))
    found, done = [], []
    while True:
        met = open_.join(by_key(ahead), [*keys, "__look"]).filter(accept(last, row, F)).groupBy(
            *keys, "__s_stretch", "__exit").agg(F.min("__to").alias("__to"))
        tried = cut_lineage(open_.join(by_key(met), [*keys, "__s_stretch", "__exit"], "left").join(by_key(after), [*keys, "__look"]), narrow=True)
        done.append(tried)
        found.append(tried.filter("__to is not null").select(
            *keys, "__s_stretch", "__exit", F.col("__look").alias("__to_stretch"), "__to"))
        rest = tried.filter("__to is null and __then is not null")
        if rest.isEmpty():
            break
        open_ = rest.select(*keys, "__s_stretch", *item, "__exit", F.col("__then").alias("__look"))
    together = found[0]
    for one in found[1:]:
        together = together.unionByName(one)
    return together, done


def _begins(steps: DataFrame, spans: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """``__begin`` for every stretch on its key's path: the place where the chain enters it. At most ``most`` stretches a key."""
    node = ["__s_stretch", "__exit"]
    jumps = []
    jump = steps
    for _ in range(max(0, (most - 1).bit_length())):
        written = cut_lineage(jump, narrow=True)
        jumps.append(written)
        second = written.select(
            *keys, F.col("__s_stretch").alias("__to_stretch"), F.col("__exit").alias("__mid"),
            F.col("__to_stretch").alias("__far_stretch"), F.col("__to").alias("__far"))
        jump = written.withColumn("__mid", F.col("__to.__exit")).join(by_key(second), [*keys, "__to_stretch", "__mid"]).select(
            *keys, *node, F.col("__far_stretch").alias("__to_stretch"), F.col("__far").alias("__to"))
    # the first rows, then all that one jump of 1, 2, 4... adds
    reached = spans.filter("__nth = 1").select(*keys, "__s_stretch", "__exit", F.lit(0).alias("__begin"))
    for written in jumps:
        reached = reached.join(by_key(written), [*keys, *node], "left").select(*keys, F.explode(F.array(
            F.struct(*node, "__begin"),
            F.when(F.col("__to").isNotNull(), F.struct(
                F.col("__to_stretch").alias("__s_stretch"), F.col("__to.__exit").alias("__exit"),
                F.col("__to.__at").alias("__begin"))))).alias("__e")).filter("__e is not null").select(*keys, "__e.*")
    out = cut_lineage(reached.select(*keys, "__s_stretch", "__begin"), narrow=True)
    release(*jumps)
    return out
