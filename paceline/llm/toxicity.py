"""Toxic notes, by a classifier that swapping identity terms does not move."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.session import cut_lineage, release

#: Labelled rows that a model is fitted on at most.
MAX_ROWS = 10_000
#: Features that a model has at most.
MAX_FEATURES = 1_024
#: Labelled rows of the toxic class that a feature has to occur in.
MIN_ROWS = 3
#: Lengths of word beginnings that are features beside whole words.
PREFIXES = (3, 4, 5, 6)
BUCKETS = 1 << 20
KEPT_BUCKETS = 8_192
#: Neutral words of the corpus that are swapped beside the identity terms, at most.
NEUTRAL_TERMS = 64
#: Share of either class's rows that a neutral word has to occur in, and the chi-square that it has to stay under.
NEUTRAL_SHARE, NEUTRAL_CHI = 0.02, 2.7
#: Neighbours are counted in so many buckets a side; words with contexts at least so similar stand for each other.
CONTEXT_BUCKETS, CONTEXT_COSINE = 128, 0.5

#: Rows that are written out at a time where the fit needs them so.
GRAM_ROWS = 1_024

#: Terms for groups of people that stand for each other in a sentence; a term is swapped within its row.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"),
    ("gay", "straight", "lesbian", "bisexual"), ("trans", "transgender", "cisgender"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "american"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("immigrants", "natives", "refugees", "foreigners"), ("disabled", "blind", "deaf"), ("old", "young", "elderly"),
    ("guards", "visitors", "cleaners", "contractors"), ("guard", "visitor", "cleaner", "contractor"),
)

_WORD = re.compile(r"\w+")
_SENTENCE_END = re.compile(r"[.!?\n]+")


def words_of(notes: str | None) -> set[str]:
    return set(_WORD.findall((notes or "").lower()))


def features_of(words: set[str]) -> set[str]:
    """The words, and the beginnings of longer ones with a star."""
    found = set(words)
    for k in PREFIXES:
        found.update(w[:k] + "*" for w in words if len(w) > k)
    return found


def swapped(words: set[str], terms: Sequence[Sequence[str]], shift: int = 1) -> set[str]:
    """The words with each identity term replaced by the one ``shift`` places on in its row."""
    turned = {}
    for row in terms:
        for at, term in enumerate(row):
            if term in words:
                turned[term] = row[(at + shift) % len(row)]
    return (words - turned.keys()) | set(turned.values()) if turned else words


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of features by name, and the constant. A score needs nothing but the notes.

    ``terms`` are the rows of terms that were swapped, ``swaps`` how many sentences could be swapped with them.
    """

    weights: dict[str, float]
    constant: float
    terms: tuple[tuple[str, ...], ...] = ()
    swaps: int = 0

    def score(self, notes: str | None) -> float:
        words, weights = words_of(notes), self.weights
        total = self.constant
        for w in words:
            total += weights.get(w, 0.0)
        for k in PREFIXES:
            for p in {w[:k] for w in words if len(w) > k}:
                total += weights.get(p + "*", 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -60.0, 60.0))))


def _bucket_counts(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for notes, toxic in zip(batch.column("notes"), batch.column("toxic"), strict=True):
                found = np.fromiter({_bucket(f) for f in features_of(words_of(notes.as_py()))}, np.int64)
                counts[toxic.as_py(), found] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["bucket", "n0", "n1"])

    parts = sample.select("notes", "toxic").mapInArrow(run, "bucket bigint, n0 bigint, n1 bigint")
    return parts.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _strength(n0: Column, n1: Column, total0: int, total1: int) -> Column:
    """How much oftener toxic rows have the feature, by signed chi-square."""
    a, b = n1.cast("double"), n0.cast("double")
    c, d = F.lit(float(total1)) - a, F.lit(float(total0)) - b
    turned = a * d - b * c
    return F.signum(turned) * turned * turned / (
        F.greatest(F.lit(1.0), (a + b) * (c + d)) * F.lit(float(max(1, total0) * max(1, total1))))


def _feature_counts(sample: DataFrame, buckets: set[int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for notes, toxic in zip(batch.column("notes"), batch.column("toxic"), strict=True):
                for f in features_of(words_of(notes.as_py())):
                    if _bucket(f) in buckets:
                        counts.setdefault(f, [0, 0])[toxic.as_py()] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()),
             pa.array([c[1] for c in counts.values()], pa.int64())], names=["feature", "n0", "n1"])

    parts = sample.select("notes", "toxic").mapInArrow(run, "feature string, n0 bigint, n1 bigint")
    return parts.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _contexts(sample: DataFrame, words: set[str]) -> DataFrame:
    """How often each word has neighbours of each bucket before it, and after it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], int] = {}
        for batch in batches:
            for notes in batch.column("notes"):
                line = _WORD.findall((notes.as_py() or "").lower())
                for at, word in enumerate(line):
                    if word in words:
                        for side, other in ((0, at - 1), (1, at + 1)):
                            if 0 <= other < len(line):
                                place = side * CONTEXT_BUCKETS + _bucket(line[other]) % CONTEXT_BUCKETS
                                counts[word, place] = counts.get((word, place), 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in counts], pa.string()), pa.array([p for _, p in counts], pa.int32()),
             pa.array(list(counts.values()), pa.int64())], names=["word", "place", "n"])

    parts = sample.select("notes").mapInArrow(run, "word string, place int, n bigint")
    return parts.groupBy("word", "place").agg(F.sum("n").alias("n"))


def neutral_pairs(
    sample: DataFrame, bucket_counts: DataFrame, n0: int, n1: int, most: int, known: set[str],
) -> list[tuple[str, str]]:
    """Pairs of frequent words that say nothing about the class and are used alike, from the sample itself.

    Neutral is a word that both classes have, in at least ``NEUTRAL_SHARE`` of
    their rows, and no oftener than chance allows; the ``most`` commonest are
    taken. Two of them stand for each other if the words around them are
    distributed alike; the most similar are paired first.
    """
    def neutral(df: DataFrame) -> DataFrame:
        chi = F.abs(_strength(F.col("n0"), F.col("n1"), n0, n1)) * F.lit(float(n0 + n1))
        return df.filter((F.col("n0") >= max(1.0, NEUTRAL_SHARE * n0)) & (F.col("n1") >= max(1.0, NEUTRAL_SHARE * n1)) & (chi < NEUTRAL_CHI))

    often = F.col("n0") + F.col("n1")
    buckets = {r["bucket"] for r in neutral(bucket_counts).orderBy(often.desc(), "bucket").limit(KEPT_BUCKETS).select("bucket").collect()}
    words = [r["feature"] for r in neutral(_feature_counts(sample, buckets)).filter(~F.col("feature").endswith("*")).orderBy(
        often.desc(), "feature").limit(most + len(known)).select("feature").collect() if r["feature"] not in known][:most]
    at = {w: k for k, w in enumerate(words)}
    around = np.zeros((len(words), 2 * CONTEXT_BUCKETS))
    for r in _contexts(sample, set(words)).collect():
        around[at[r["word"]], r["place"]] = r["n"]
    around /= np.maximum(np.linalg.norm(around, axis=1, keepdims=True), 1e-12)
    alike = np.triu(around @ around.T, 1)
    left, right = np.nonzero(alike >= CONTEXT_COSINE)
    pairs, used = [], set()
    for k in np.lexsort((right, left, -np.round(alike[left, right], 9))):
        one, other = int(left[k]), int(right[k])
        if not used & {one, other}:
            used |= {one, other}
            pairs.append((words[one], words[other]))
    return pairs


def swaps_of(sentence: set[str], terms: Sequence[Sequence[str]]) -> Iterator[set[str]]:
    """The sentence with the one term it has of a row swapped for each other of that row; two of a row are left as they are."""
    for row in terms:
        if sum(t in sentence for t in row) == 1:
            for shift in range(1, len(row)):
                yield swapped(sentence, (row,), shift)


def _vectors(sample: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """Per row the places of its features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(vocabulary[f] for f in features_of(words_of(n.as_py())) if f in vocabulary) for n in batch.column("notes")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(own, pa.list_(pa.int32()))], names=["toxic", "own"])

    return sample.select("notes", "toxic").mapInArrow(run, "toxic int, own array<int>")


def _differences(sample: DataFrame, vocabulary: dict[str, int], terms: Sequence[Sequence[str]]) -> DataFrame:
    """What features a sentence loses and gains by a swap, and in how many sentences of the sample."""
    places = lambda found: sorted(vocabulary[f] for f in found if f in vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[tuple[int, ...], tuple[int, ...]], int] = {}
        for batch in batches:
            for notes in batch.column("notes"):
                for text in _SENTENCE_END.split(notes.as_py() or ""):
                    words = words_of(text)
                    before = features_of(words)
                    for turned in swaps_of(words, terms):
                        after = features_of(turned)
                        key = tuple(places(before - after)), tuple(places(after - before))
                        counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([list(k[0]) for k in counts], pa.list_(pa.int32())), pa.array([list(k[1]) for k in counts], pa.list_(pa.int32())),
             pa.array(list(counts.values()), pa.int64())], names=["lost", "gained", "n"])

    parts = sample.select("notes").mapInArrow(run, "lost array<int>, gained array<int>, n bigint")
    return parts.groupBy("lost", "gained").agg(F.sum("n").alias("n"))


def _gram(places: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Rows of ones at ``places``, transposed and multiplied with themselves, a block of rows at a time. Counts, so exact."""
    total = np.zeros((width, width))
    ends = np.r_[starts[1:], len(places)]
    for at in range(0, len(starts), GRAM_ROWS):
        some = slice(at, at + GRAM_ROWS)
        sizes = ends[some] - starts[some]
        block = np.zeros((len(sizes), width))
        block[np.repeat(np.arange(len(sizes)), sizes), places[starts[at]:ends[some][-1]]] = 1
        total += block.T @ block
    return total


def fit_weights(
    rows: Sequence[Sequence[int]], y: np.ndarray, differences: np.ndarray, penalty: float, ridge: float, rounds: int = 400,
) -> tuple[np.ndarray, float]:
    """Least sum of log loss, ``ridge`` w² / 2 and ``penalty`` (d·w)² / 2 over the differences, by accelerated steps.

    ``rows`` are the places of each row's features, ``differences`` has a column for each place. Rows stay as places:
    written out they would be most of the driver's memory.
    """
    n, k = len(rows), differences.shape[1]
    sizes = np.array([len(r) + 1 for r in rows])
    starts = np.cumsum(sizes) - sizes
    # the constant is one more place that every row has
    places = np.fromiter((p for r in rows for p in (*r, k)), np.int32, int(sizes.sum()))
    shift = differences.T.astype(np.float64) @ differences if len(differences) else np.zeros((k, k))
    curve = penalty * shift + ridge * np.eye(k)
    # of each row's weight: both classes count by their size
    scale = 0.25 * np.linalg.eigvalsh(_gram(places, starts, k + 1))[-1] + np.linalg.norm(curve, 2)
    w = v = np.zeros(k + 1)
    w[k] = v[k] = np.log((y.sum() + 1.0) / (n - y.sum() + 1.0))
    t = 1.0
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(np.add.reduceat(v[places], starts), -60, 60)))
        gradient = np.bincount(places, np.repeat(p - y, sizes), k + 1)
        gradient[:k] += curve @ v[:k]
        new = v - gradient / scale
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / after * (new - w)
        w, t = new, after
    return w[:k], float(w[k])


def fit_toxicity(
    alerts: DataFrame, labels: DataFrame, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, penalty: float = 10.0,
    ridge: float = 0.05, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, min_rows: int = MIN_ROWS,
    neutral_terms: int = NEUTRAL_TERMS,
) -> ToxicityModel:
    """Fit on alerts (``id, notes``) that ``labels`` (``id, toxic`` 0 or 1) marks.

    Uses ``max_rows`` labelled rows at most, those with the smallest hash of
    their id; labels that are null or neither 0 nor 1 are passed over. Features
    are words and word beginnings; of these, the ``max_features`` that occur
    oftenest in toxic rows beyond chance (chi-square, at least ``min_rows`` toxic
    rows) and the terms that are swapped.

    These are the identity terms of ``terms`` and, for corpora that have others
    or are in other languages, up to ``neutral_terms`` words found in the sample
    (``neutral_pairs``). Every sentence of a labelled row that has one term of a
    row of terms is also read with it swapped for the others; the difference of
    the linear scores, squared and times ``penalty``, is added to the loss, once
    for each different one. A term that comes with toxic rows by accident so gets
    the weight of its counterparts, and a neutral mention is not marked for it.

    Without labelled rows of both classes the model is the share of toxic rows.
    """
    marked = labels.filter("toxic in (0, 1) and id is not null").select(
        F.col("id").alias("__label_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("__label_id"), "__label_id", "toxic").limit(max_rows)
    # broadcast: max_rows narrow rows at most
    sample = cut_lineage(
        alerts.select("id", "notes").join(F.broadcast(chosen), F.col("id") == F.col("__label_id"))
        .select("notes", "toxic"))
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        release(sample)
        return ToxicityModel({}, float(np.log((n1 + 1.0) / (n0 + 1.0))))
    strength = _strength(F.col("n0"), F.col("n1"), n0, n1)
    counted = cut_lineage(_bucket_counts(sample), narrow=True)
    buckets = {r["bucket"] for r in counted.filter(F.col("n1") >= min_rows).orderBy(
        strength.desc(), "bucket").limit(KEPT_BUCKETS).select("bucket").collect()}
    names = [r["feature"] for r in _feature_counts(sample, buckets).filter(F.col("n1") >= min_rows).filter(
        strength > 0).orderBy(strength.desc(), "feature").limit(max_features).select("feature").collect()]
    known = {t for row in terms for t in row}
    all_terms = [tuple(row) for row in terms]
    if neutral_terms:
        all_terms += neutral_pairs(sample, counted, n0, n1, neutral_terms, known)
    wanted = features_of({t for row in all_terms for t in row})
    vocabulary = {f: at for at, f in enumerate(dict.fromkeys([*names, *sorted(wanted)]))}
    rows = _vectors(sample, vocabulary).collect()
    turns = _differences(sample, vocabulary, all_terms).collect()
    release(sample, counted)
    rows.sort(key=lambda r: (r["toxic"], r["own"]))  # the same sums whatever order they come in
    y = np.array([r["toxic"] for r in rows], np.float64)
    turns.sort(key=lambda r: (r["lost"], r["gained"]))
    unique = np.zeros((len(turns), len(vocabulary)), np.float32)
    for at, turn in enumerate(turns):
        unique[at, turn["lost"]] = 1
        unique[at, turn["gained"]] = -1
    w, constant = fit_weights([r["own"] for r in rows], y, unique, penalty, ridge)
    return ToxicityModel(
        {f: float(w[at]) for f, at in vocabulary.items() if w[at]}, constant, tuple(all_terms), sum(t["n"] for t in turns))


def score_toxicity(alerts: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The alerts with ``score`` (0 to 1, higher: likelier toxic) and ``predicted`` (1 from ``threshold`` on).

    Reads whole ``notes`` (null: empty) and nothing else; all columns are handed
    on, those named like the two new ones are replaced. The model is bounded by
    its number of features and goes to the tasks with the function.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("notes")
            scores = [model.score(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    plain = alerts.drop("score", "predicted")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in plain.schema)}, score double"
    return plain.mapInArrow(run, schema).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
