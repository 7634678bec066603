"""A Merkle manifest of an alert log: one root for all records, and for every record the proof that leads to it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.session import cut_lineage, release

#: Children of a node.
ARITY = 3
#: Levels within a leaf partition, which so has 729 leaves that stand together.
LEVELS = 6
#: Fields of a density alert that its leaf covers.
FIELDS = ("id", "stream_id", "zone_id", "density_count", "notes")

Places = dict[int, str]


def leaf_digest(fields: Sequence[str | Column]) -> Column:
    """SHA-256 (lowercase hex) over the fields, each as ``-`` if null, else UTF-8 byte count, ``:`` and the value."""

    def item(field: str | Column) -> Column:
        text = (F.col(field) if isinstance(field, str) else field).cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[item(f) for f in fields]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest gives with a proof: each step hashes what is left of it, itself, and what is right."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof as one text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


# ---- coordinates and nodes of one tree


def _parent_size(size: int) -> int:
    return -(-size // ARITY)


def missing_nodes(places: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """``level, places`` of the fewest nodes that prove all the leaves at ``places`` (ascending) of ``size`` together.

    Going up, a node is needed if it is a child of a node above one of the
    leaves, and neither is one of them nor above one: all others can be derived.
    """
    found, level = [], 0
    while size > 1:
        parents = np.unique(places // ARITY)
        children = (parents[:, None] * ARITY + np.arange(ARITY)).ravel()
        found.append((level, np.setdiff1d(children[children < size], places, assume_unique=True)))
        places, size, level = parents, _parent_size(size), level + 1
    return found


def _hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _climb(nodes: Places, size: int, levels: int, inner: bool) -> Iterator[tuple[int, Places, int]]:
    """``level, nodes, size`` above whole runs, up to ``levels`` higher and until one node is left; the last level or each."""
    level, nodes = 0, dict(sorted(nodes.items()))
    while size > 1 and level < levels:
        up: dict[int, list[str]] = {}
        for place, digest in nodes.items():
            up.setdefault(place // ARITY, []).append(digest)
        nodes, size, level = {p: _hash(run) for p, run in up.items()}, _parent_size(size), level + 1
        if inner:
            yield level, nodes, size
    if not inner:
        yield level, nodes, size


def _derive(nodes: Places, fetched: dict[int, Places], size: int) -> tuple[list[dict[int, tuple[str, str]]], str]:
    """Per level what is left and right of each node on the way up, and the digest at the top.

    ``nodes`` are leaves by ascending place; nodes that several of them share are derived once.
    """
    steps, level = [], 0
    while size > 1:
        known, up, beside = {**fetched.get(level, {}), **nodes}, {}, {}
        for parent in dict.fromkeys(p // ARITY for p in nodes):
            first = parent * ARITY
            run = [known[p] for p in range(first, min(first + ARITY, size))]
            up[parent] = _hash(run)
            for k in range(len(run)):
                if first + k in nodes:
                    beside[first + k] = "".join(run[:k]), "".join(run[k + 1:])
        steps.append(beside)
        nodes, size, level = up, _parent_size(size), level + 1
    return steps, next(iter(nodes.values()))


def _expand(steps: list[dict[int, tuple[str, str]]], above: list[tuple[str, str]]) -> dict[int, list[tuple[str, str]]]:
    """The proof of every leaf: its own step, and its parent's proof, which is made once for the whole run."""
    proofs = {0: above}
    for beside in reversed(steps):
        proofs = {place: [step, *proofs[place // ARITY]] for place, step in beside.items()}
    return proofs


# ---- places of records, without a window over a whole key


def _placed(rows: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` (written, in order) with ``__spot``, and per range and key ``__range, __first, __before, __size``.

    Rows are sorted by ranges, and ranges counted: a key may fill any number of them.
    """
    spot = cut_lineage(rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order).withColumn(
        "__spot", F.monotonically_increasing_id()))
    ranges = spot.groupBy(F.shiftright("__spot", 33).alias("__range"), *key).agg(
        F.min("__spot").alias("__first"), F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy(*(key or [F.lit(0)]))
    before = along.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return spot, ranges.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn(
        "__size", F.sum("__n").over(along))


_NODE = "top boolean, tree bigint, size bigint, level int, place bigint, digest string, last boolean"
_WANTED = "tree bigint, block bigint, top boolean, of_tree bigint, level int, place bigint"


def _columns(rows: list[tuple], types: list[pa.DataType], names: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
        names=[f.split()[0] for f in names.split(", ")])


def _nodes_above(blocks: DataFrame, level: int, levels: int, inner: bool) -> DataFrame:
    """The nodes above each block of a tree, up to ``levels`` higher, or only the last of them.

    ``blocks`` has ``top, tree, size, nodes``: runs of the ``size`` nodes that the
    tree has on ``level``. In what comes out, ``size`` is that of the node's own level.
    """
    types = [pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for up, nodes, size in _climb({n["place"]: n["digest"] for n in r["nodes"]}, r["size"], levels, inner):
                    rows += [(r["top"], r["tree"], size, level + up, p, d, size == 1) for p, d in nodes.items()]
            yield _columns(rows, types, _NODE)

    return blocks.mapInArrow(run, _NODE)


def _tree_tables(blocks: DataFrame, size: int, levels: int, inner: bool) -> list[DataFrame]:
    """Written tables of nodes, a round for every ``levels`` of trees of ``size`` leaves at most."""
    tables, level = [], 0
    while True:
        tables.append(cut_lineage(_nodes_above(blocks, level, levels, inner), narrow=True))
        size, level, inner = -(-size // ARITY ** levels), level + levels, True
        if size <= 1:
            return tables
        blocks = tables[-1].filter((F.col("level") == level) & ~F.col("last")).groupBy(
            "top", "tree", "size", F.floor(F.col("place") / ARITY ** levels).alias("block")).agg(
            F.collect_list(F.struct("place", "digest")).alias("nodes"))


def _union(tables: list[DataFrame]) -> DataFrame:
    together = tables[0]
    for table in tables[1:]:
        together = together.unionByName(table)
    return together


def _wanted(parts: DataFrame) -> DataFrame:
    """What each leaf partition lacks: nodes of its camera's tree, and of the top tree beside the camera's subroot."""
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                own, top = (r["size"], np.array(r["places"])), (r["trees"], np.array([r["tree"]]))
                for is_top, (size, places) in ((False, own), (True, top)):
                    rows += [(r["tree"], r["block"], is_top, 0 if is_top else r["tree"], level, int(p))
                             for level, lacking in missing_nodes(places, size) for p in lacking]
            yield _columns(rows, types, _WANTED)

    return parts.select("tree", "block", "size", "trees", F.col("leaves.place").alias("places")).mapInArrow(run, _WANTED)


def _proofs(parts: DataFrame, nodes: DataFrame, group: str) -> DataFrame:
    """Proofs of all leaves of ``parts``; nodes that a partition lacks come with it, each once."""
    fetched = _wanted(parts).join(
        nodes.select("top", F.col("tree").alias("of_tree"), "level", "place", "digest"),
        ["top", "of_tree", "level", "place"]).groupBy("tree", "block").agg(
        F.collect_list(F.struct("top", "level", "place", "digest")).alias("fetched"))
    record = parts.schema["leaves"].dataType.elementType["record"].dataType
    step = pa.struct([("left", pa.string()), ("right", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in ("tree", "size", "trees", "fetched")}
                sides: dict[bool, dict[int, Places]] = {False: {}, True: {}}
                for n in r["fetched"] or ():
                    sides[n["top"]].setdefault(n["level"], {})[n["place"]] = n["digest"]
                leaves = batch.column("leaves").slice(k, 1).flatten()
                places, digests = leaves.field("place").to_pylist(), leaves.field("leaf")
                steps, subroot = _derive(dict(zip(places, digests.to_pylist(), strict=True)), sides[False], r["size"])
                above, root = _derive({r["tree"]: subroot}, sides[True], r["trees"])
                shared = _expand(above, [])[r["tree"]]
                proofs = _expand(steps, shared)
                flat = [s for p in places for s in proofs[p]]
                depth = len(steps) + len(shared)
                beside = pa.StructArray.from_arrays(
                    [pa.array([s[i] for s in flat], pa.string()) for i in (0, 1)], fields=list(step))
                own = leaves.field("record")
                same = pa.array([k] * len(places), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column("group").take(same), *[own.field(i) for i in range(own.type.num_fields)], digests,
                    pa.array([subroot] * len(places), pa.string()), pa.array([root] * len(places), pa.string()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1) * depth, pa.int32()), beside)],
                    names=["__group", *own.type.names, "leaf", "subroot", "root", "proof"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in record.fields)
    group_kind = parts.schema["group"].dataType.simpleString()
    return parts.join(fetched, ["tree", "block"], "left").mapInArrow(
        run, f"__group {group_kind}, {kinds}, leaf string, subroot string, root string, "
             "proof array<struct<left: string, right: string>>").withColumnRenamed("__group", group)


# ---- the manifest


def manifest_proofs(
    alerts: DataFrame, fields: Sequence[str] = FIELDS, key: str = "id", group: str = "stream_id",
    carry: Sequence[str] = (), levels: int = LEVELS,
) -> DataFrame:
    """Leaf, subroot, root and proof of every alert, all under one root.

    ``alerts`` is an alert log; a record's leaf covers its ``fields`` (numbers
    without fractions and texts, see ``leaf_digest``). Per ``group`` (a camera)
    leaves ascend by ``key``, then by digest; while several nodes remain, every
    three that follow each other (the last run may be shorter, even one) become
    the SHA-256 of their digests. What remains is the camera's subroot; the
    subroots, by group (null first, then by UTF-8 bytes), give the root likewise.

    Returns a row per alert: ``group`` and ``key`` under their names, the ``carry``
    columns, ``leaf, subroot, root`` and ``proof``, an array of ``left, right``: the
    digests beside the leaf's node at each level of its camera's tree and then of
    the top tree (both empty where a run is one node). ``fold(leaf, proof)`` is the
    root, with any other leaf it is not. Null fields are part of the leaf; null keys
    come first; rows that repeat are leaves of their own; an empty log gives no rows.

    Leaves are dealt by group and place into partitions of ``3 ** levels`` neighbours
    (729). Each partition works out which nodes its leaves' proofs lack in all
    (``missing_nodes``: an octopus of the single paths), gets each of them once,
    derives what its leaves share, and expands the single proofs by itself. A
    camera with any share of the records is spread over the cluster: no step
    holds more of it than a partition.
    """
    names = [key, *carry]
    rows = alerts.select(
        F.col(group).alias("__group"), F.col(key).alias("__key"), leaf_digest(fields).alias("__leaf"),
        F.struct(*names).alias("__record"))
    narrow = cut_lineage(rows)
    spot, ranges = _placed(narrow, ["__group"], ["__key", "__leaf"])
    release(narrow)
    groups, group_ranges = _placed(ranges.groupBy("__group").agg(F.first("__size").alias("__size")), [], ["__group"])
    ranked = groups.withColumn("__range", F.shiftright("__spot", 33)).join(
        group_ranges.withColumnsRenamed({"__size": "__trees"}), "__range").select(
        F.col("__group").alias("__g"), (F.col("__before") + F.col("__spot") - F.col("__first")).alias("__tree"), "__trees")
    spread = cut_lineage(ranges.join(ranked, F.col("__group").eqNullSafe(F.col("__g"))).select(
        F.col("__range").alias("__r"), F.col("__group").alias("__g"), "__first", "__before", "__size", "__tree", "__trees"),
        narrow=True)
    most, trees = spread.agg(F.max("__size"), F.max("__trees")).first()
    size = ARITY ** levels
    placed = spot.join(spread, (F.shiftright("__spot", 33) == F.col("__r")) & F.col("__group").eqNullSafe(F.col("__g"))).select(
        F.col("__tree").alias("tree"), F.col("__trees").alias("trees"), F.col("__size").alias("size"),
        (F.col("__before") + F.col("__spot") - F.col("__first")).alias("place"), F.col("__group").alias("group"),
        F.col("__leaf").alias("leaf"), F.col("__record").alias("record"))
    # a leaf partition is a row from here on
    parts = cut_lineage(placed.groupBy("tree", F.floor(F.col("place") / size).alias("block")).agg(
        F.first("group").alias("group"), F.first("size").alias("size"), F.first("trees").alias("trees"),
        F.sort_array(F.collect_list(F.struct("place", "leaf", "record"))).alias("leaves")))
    release(spot, groups, spread)

    ready = parts.select(
        F.lit(False).alias("top"), "tree", "size",
        F.transform("leaves", lambda x: F.struct(x["place"].alias("place"), x["leaf"].alias("digest"))).alias("nodes"))
    tables = _tree_tables(ready, most or 1, levels, False)
    # subroots are the leaves of the top tree
    under = cut_lineage(_union(tables).filter("last").select(
        F.lit(True).alias("top"), F.lit(0).cast("long").alias("tree"), F.lit(trees or 1).cast("long").alias("size"),
        F.lit(0).alias("level"), F.col("tree").alias("place"), "digest", F.lit((trees or 1) == 1).alias("last")), narrow=True)
    top = _tree_tables(under.groupBy("top", "tree", "size", F.floor(F.col("place") / size).alias("block")).agg(
        F.collect_list(F.struct("place", "digest")).alias("nodes")), trees or 1, levels, True)
    return _proofs(parts, _union([*tables, under, *top]), group)
