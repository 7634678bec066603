"""Near copies among the embeddings of tracks: an epsilon grid order join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import spread_join
from paceline.llm.components import components
from paceline.session import cut_lineage, release

#: Least cosine of two linked embeddings.
COSINE = 0.93
#: Leading principal dimensions that the grid is laid over.
GRID_DIMENSIONS = 4
#: Vectors in a leaf interval of the order, at most.
LEAF = 512
#: Intervals of a level that make one of the next.
FAN = 4
#: Kept off the bounds of boxes and cells, far above the rounding of doubles.
SLACK = 1e-7


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def prepare(tracks: DataFrame) -> DataFrame:
    """``row, stream_id, track_id, digest, dim, unit``: vectors that can be linked get a digest and their unit vector.

    Null, empty and zero vectors and those with null or non-finite components
    have neither, nor have rows without camera.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, dims, units = [], [], []
            for stream, item in zip(batch.column("stream_id"), batch.column("embedding"), strict=True):
                values = item.as_py()
                vector = None
                if stream.is_valid and values and not any(v is None for v in values):
                    raw = np.array(values, np.float64) + 0.0  # no negative zero
                    top = np.abs(raw).max() if np.isfinite(raw).all() else 0.0
                    if top > 0:
                        vector = raw / top  # so that squares neither vanish nor overflow
                        vector = vector / np.sqrt(vector @ vector)
                digests.append(None if vector is None else hashlib.sha256(raw.tobytes()).digest()[:16])
                dims.append(None if vector is None else len(vector))
                units.append(None if vector is None else vector.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("stream_id"), batch.column("track_id"), pa.array(digests, pa.binary()),
                 pa.array(dims, pa.int32()), pa.array(units, pa.binary())],
                names=["stream_id", "track_id", "digest", "dim", "unit"])

    return tracks.select("stream_id", "track_id", "embedding").mapInArrow(
        run, f"stream_id {_kind(tracks, 'stream_id')}, track_id {_kind(tracks, 'track_id')}, digest binary, dim int, "
        "unit binary")


def principal_axes(vectors: DataFrame, dim: int, count: int) -> np.ndarray:
    """The ``count`` leading axes of all unit vectors of ``dim`` components, as columns.

    Sums of products are added up over the cluster; dim x dim numbers reach the
    driver. They only steer what is skipped, never what is linked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim + 1, dim)), 0
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("unit").to_pylist()), np.float64).reshape(-1, dim)
                total[:dim] += x.T @ x
                total[dim] += x.sum(axis=0)
                n += len(x)
        if n:
            flat = np.r_[total.ravel(), n]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "v"])

    sums = vectors.select("unit").mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v"))
    flat = np.zeros((dim + 1) * dim + 1)
    for r in sums.collect():
        flat[r["at"]] = r["v"]
    n = max(1.0, flat[-1])
    total = flat[:-1].reshape(dim + 1, dim)
    spread = total[:dim] / n - np.outer(total[dim] / n, total[dim] / n)
    return np.linalg.eigh(spread)[1][:, ::-1][:, :count]


def _ordered(vectors: DataFrame, axes: np.ndarray, radius: float, leaf: int) -> DataFrame:
    """The vectors in epsilon grid order, cut into leaf intervals: adds ``leaf`` and the coordinates ``p0``, ``p1``..."""
    dim, count = axes.shape
    names = [f"p{i}" for i in range(count)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("unit").to_pylist()), np.float64).reshape(-1, dim) @ axes
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(np.ascontiguousarray(x[:, i])) for i in range(count)]],
                names=[*batch.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    placed = vectors.mapInArrow(project, f"{fields}, {', '.join(f'{n} double' for n in names)}")
    cells = [F.floor(F.col(n) / F.lit(radius)) for n in names]
    order = ["stream_id", *[f"c{i}" for i in range(count)], "digest"]
    sorted_ = placed.withColumns({f"c{i}": c for i, c in enumerate(cells)}).repartitionByRange(
        *order).sortWithinPartitions(*order).drop(*[f"c{i}" for i in range(count)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, now = -1, leaf, None
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            leaves = []
            for stream in batch.column("stream_id").to_pylist():
                if held >= leaf or stream != now:
                    at, held, now = at + 1, 0, stream
                held += 1
                leaves.append(base + at)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(leaves, pa.int64())], names=[*batch.schema.names, "leaf"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_.schema)
    return cut_lineage(sorted_.mapInArrow(cut, f"{fields}, leaf bigint"))


def _boxes(rows: DataFrame, key: str, names: list[str], low: str, high: str) -> DataFrame:
    return rows.groupBy("stream_id", F.col(key).alias("box")).agg(
        *[F.min(low.format(n)).alias(f"{n}_low") for n in names],
        *[F.max(high.format(n)).alias(f"{n}_high") for n in names])


def _levels(leaves: DataFrame, names: list[str], fan: int) -> list[DataFrame]:
    """Intervals from leaves up to one per camera: ``stream_id, box, parent`` and bounds; each a written table."""
    from pyspark.sql import Window

    # positions within a camera: partitions of the sorted table are counted, not sorted again
    found = []
    now = _boxes(leaves, "leaf", names, "{}", "{}")
    rank = F.row_number().over(Window.partitionBy("stream_id").orderBy("box")) - 1
    level = cut_lineage(now.withColumn("parent", F.floor(rank / F.lit(fan)).cast("long")), narrow=True)
    found.append(level)
    while True:
        up = _boxes(level.drop("box"), "parent", names, "{}_low", "{}_high")
        level = cut_lineage(up.withColumn("parent", F.floor(F.col("box") / F.lit(fan)).cast("long")), narrow=True)
        found.append(level)
        if level.filter("box > 0").isEmpty():
            return found


def _near(names: list[str], radius: float):
    gap = F.lit(0.0)
    for n in names:
        apart = F.greatest(
            F.lit(0.0), F.col(f"a.{n}_low") - F.col(f"b.{n}_high"), F.col(f"b.{n}_low") - F.col(f"a.{n}_high"))
        gap = gap + apart * apart
    return gap <= F.lit((radius + SLACK) ** 2)


def interval_pairs(leaves: DataFrame, names: list[str], radius: float, fan: int = FAN) -> DataFrame:
    """``stream_id, a, b`` (a <= b): pairs of leaf intervals whose boxes come within ``radius``.

    From the top, each pair of intervals is replaced by the pairs of their parts;
    pairs that are provably farther apart are skipped with all below them.
    """
    levels = _levels(leaves, names, fan)
    pairs = levels[-1].select("stream_id", F.col("box").alias("a"), F.col("box").alias("b"))
    for level in reversed(levels[:-1]):
        first = level.select("stream_id", "box", "parent", *[f"{n}_{s}" for n in names for s in ("low", "high")])
        one = pairs.join(first.alias("a"), (pairs["stream_id"] == F.col("a.stream_id")) & (
            pairs["a"] == F.col("a.parent"))).select(F.col("b").alias("right"), F.struct("a.*").alias("a"))
        both = one.join(first.alias("b"), (F.col("a.stream_id") == F.col("b.stream_id")) & (
            F.col("right") == F.col("b.parent")))
        pairs = cut_lineage(both.filter((F.col("a.box") <= F.col("b.box")) & _near(names, radius)).select(
            F.col("a.stream_id").alias("stream_id"), F.col("a.box").alias("a"), F.col("b.box").alias("b")), narrow=True)
    release(*levels)
    return pairs


def _connected(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between two lists: the least place of each one's component, over both lists (the second after the first)."""
    n, m = mask.shape
    left, right = np.arange(n), np.arange(n, n + m)
    far = n + m
    while True:
        new = np.minimum(left, np.where(mask, right[None, :], far).min(axis=1, initial=far))
        other = np.minimum(right, np.where(mask, new[:, None], far).min(axis=0, initial=far))
        if (new == left).all() and (other == right).all():
            return left, right
        left, right = new, other


def _linked(i: np.ndarray, x: np.ndarray, n_i: np.ndarray, j, y, n_j, least: float):
    """Of two intervals, or of one with itself (``j`` None): row, the row it hangs on, and how many rows it is linked to."""
    if j is None:
        mask = x @ x.T >= least
        np.fill_diagonal(mask, False)
        links, both = mask @ n_i, i
        of = _connected(mask | np.eye(len(i), dtype=bool))[0] if mask.any() else np.arange(len(i))
    else:
        mask = x @ y.T >= least
        if not mask.any():
            return i[:0], i[:0], n_i[:0]
        links, both, of = np.r_[mask @ n_j, mask.T @ n_i], np.r_[i, j], np.concatenate(_connected(mask))
    hit = np.flatnonzero(links)
    return both[hit], both[of[hit]], links[hit]


def _compare(dim: int, least: float):
    """Over rows sorted by pair of intervals and side; one pair is held at a time."""

    def work(parts: list[tuple]):
        side, rep, n, unit = (np.concatenate(c) for c in zip(*parts, strict=True))
        x = unit.reshape(-1, dim)
        first = side == 0
        if first.all():
            return _linked(rep, x, n, None, None, None, least)
        return _linked(rep[first], x[first], n[first], rep[~first], x[~first], n[~first], least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out(found):
            found = [np.concatenate(c) for c in zip(*found, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "b", "links"])

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, side, rep, n = (batch.column(c).to_numpy() for c in ("a", "b", "side", "rep", "n"))
            units = np.frombuffer(b"".join(batch.column("unit").to_pylist()), np.float64).reshape(-1, dim)
            cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            found = []
            for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(a)], strict=True):
                pair = (a[start], b[start])
                if now is not None and pair != now:
                    found.append(work(held))
                    held = []
                now = pair
                held.append((side[start:end], rep[start:end], n[start:end], units[start:end].ravel()))
            if found:
                yield out(found)
        if held:
            yield out([work(held)])

    return run


def near_duplicate_embeddings(
    tracks: DataFrame, cosine: float = COSINE, leaf: int = LEAF, fan: int = FAN,
    grid_dimensions: int = GRID_DIMENSIONS,
) -> DataFrame:
    """Groups of tracks of a camera whose embeddings nearly point the same way.

    ``tracks`` has ``stream_id``, ``track_id`` (a number, one row per vector) and
    ``embedding``; other columns are not read. Vectors of one camera and the same
    number of components are linked when their cosine, in double precision, is at
    least ``cosine``. Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing, nor do rows without camera.

    Returns a row per vector: ``stream_id, track_id, n_links`` (other rows linked
    directly), ``component_id`` (smallest track id reachable) and ``kept``
    (whether that is its own). Repeated rows count as rows of their own and are
    linked; an empty table gives no rows.

    Equal vectors fall together first and count by their number. The others are
    sorted by cells of width epsilon (the distance of unit vectors that the cosine
    stands for) on their leading principal dimensions, and cut into intervals;
    pairs of intervals are refined from the top and skipped where their boxes
    are provably farther apart. Each remaining pair of leaf intervals is one
    product of two small matrices. Only a spanning tree of its links is put out.
    """
    radius = float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine)))
    rows = cut_lineage(prepare(tracks).withColumn("row", F.monotonically_increasing_id()))
    distinct = cut_lineage(
        rows.filter("digest is not null").groupBy("stream_id", "dim", "digest").agg(
            F.min("row").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("track_id").alias("first_id"),
            F.first("unit").alias("unit")))
    dims = [r["dim"] for r in distinct.select("dim").distinct().collect()]
    links = None
    for dim in dims:
        own = distinct.filter(F.col("dim") == dim).select("stream_id", "digest", "rep", "n", "unit")
        count = min(grid_dimensions, dim)
        leaves = _ordered(own, principal_axes(own, dim, count), radius + SLACK, leaf)
        pairs = interval_pairs(leaves, [f"p{i}" for i in range(count)], radius, fan)
        own_side = F.struct(F.lit(0).alias("side"), F.col("a").alias("leaf"))
        other_side = F.struct(F.lit(1).alias("side"), F.col("b").alias("leaf"))
        sides = pairs.select("a", "b", F.inline(F.when(F.col("a") == F.col("b"), F.array(own_side)).otherwise(
            F.array(own_side, other_side))))
        met = sides.join(leaves.select("leaf", "rep", "n", "unit"), "leaf").select("a", "b", "side", "rep", "n", "unit")
        found = met.repartition("a", "b").sortWithinPartitions("a", "b", "side").mapInArrow(
            _compare(dim, cosine), "a bigint, b bigint, links bigint")
        links = found if links is None else links.unionByName(found)
    if links is None:
        return rows.select(
            "stream_id", "track_id", F.lit(0).cast("long").alias("n_links"), F.col("track_id").alias("component_id"),
            F.lit(True).alias("kept"))
    links = cut_lineage(links)
    totals = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("others"))
    roots = components(links.select("a", "b")).withColumnRenamed("node", "rep")
    rooted = cut_lineage(
        distinct.join(totals, "rep", "left").join(roots, "rep", "left").select(
            "stream_id", "digest", "dim", "rep", "n", "first_id",
            (F.coalesce("others", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"),
            F.coalesce("root", "rep").alias("root")), narrow=True)
    least = cut_lineage(rooted.groupBy("root").agg(
        F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("weight")), narrow=True)
    named = cut_lineage(
        spread_join(rooted, least, ["root"], "weight", ["component_id"], F.col("rep"))
        .select("stream_id", "dim", "digest", "n", "n_links", "component_id"), narrow=True)
    release(distinct, links, rooted, least)
    whole = spread_join(
        rows.drop("unit"), named, ["stream_id", "dim", "digest"], "n", ["n_links", "component_id"], F.col("row"))
    lone = F.col("digest").isNull()
    component = F.when(lone, F.col("track_id")).otherwise(F.col("component_id"))
    return whole.select(
        "stream_id", "track_id", F.when(lone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("track_id").eqNullSafe(component).alias("kept"))
