"""What concurrent and repeated writers leave behind once: outputs by batch, and an alert log with versions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.operators.alertlog import attach_clip, recent
from paceline.sources.sinks import Handler


class _Folder:
    """Small files of a folder in any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.path = path.rstrip("/")
        self.fs = self._at("").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        if not self.fs.exists(self._at("")):
            return []
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self._at("")))

    def mark(self, name: str) -> None:
        """An empty file, there at once or not at all."""
        self.fs.mkdirs(self._at(""))
        self.fs.createNewFile(self._at(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def claim(self, name: str, text: str) -> bool:
        """Put a whole file under a name that nobody has taken; False if somebody has."""
        own = f".{uuid.uuid4().hex}"
        self.fs.mkdirs(self._at(""))
        out = self.fs.create(self._at(own), True)
        out.write(text.encode())
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        no_options = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._at(own), self._at(name), no_options)
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
                raise
            self.delete(own)
            return False

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


# --------------------------------------------------------------------------- several outputs of a batch


def outputs_sink(path: str, outputs: dict[str, Callable[[DataFrame], DataFrame]]) -> Handler:
    """A handler that writes every output of a micro-batch exactly once.

    ``outputs`` are functions from the batch to a table, such as its displayed
    tracks, zone counts and crossings; each is written below ``path`` by its name
    and the batch. A ledger notes how many of them are done. A batch that failed
    between two of them goes on with the first that is not done; one that was
    done altogether, but is handed over again, is passed over. ``read_output``
    shows a batch only when all its outputs are there.

    Batches come in order of their ids, as Spark hands them over, so that the
    ledger is the newest of its marks and the others are deleted.
    """
    names = sorted(outputs)

    def write(batch: DataFrame, batch_id: int) -> None:
        ledger = _Folder(batch.sparkSession, f"{path}/_ledger")
        at, done, _ = _newest(ledger)
        if at > batch_id:
            return
        done = done if at == batch_id else 0
        if done == len(names):
            return
        batch.persist()
        try:
            for place, name in enumerate(names[done:], done + 1):
                outputs[name](batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={int(batch_id)}")
                ledger.mark(_mark(batch_id, place, len(names)))
        finally:
            batch.unpersist()
        for old in ledger.names():
            if old < _mark(batch_id, len(names), len(names)):
                ledger.delete(old)

    return write


def _mark(batch_id: int, done: int, of: int) -> str:
    return f"{batch_id:018d}-{done:04d}-{of:04d}"


def _newest(ledger: _Folder) -> tuple[int, int, int]:
    """Batch, outputs that are done, outputs it has; batch -1 before the first."""
    names = ledger.names()
    batch, done, of = names[-1].split("-") if names else ("-1", 0, 0)
    return int(batch), int(done), int(of)


def read_output(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """One output of ``outputs_sink``, with ``batch``, up to the last batch of which all outputs are written; None before."""
    at, done, of = _newest(_Folder(spark, f"{path}/_ledger"))
    last = at if done == of else at - 1
    if last < 0:
        return None
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").filter(F.col("batch") <= last)


# --------------------------------------------------------------------------- the alert log


class AlertLog:
    """A log of alerts that batch jobs and streams write alike, with clips that are attached later.

    Rows lie in parts, one for each commit, laid out by camera and sorted by zone
    and time; clips lie in parts of their own and are merged when the log is
    read. Which parts count is said by the newest file in ``_manifest``. A commit
    writes its part first and then claims the next number; if another writer was
    faster, it looks again and claims the number after. A part numbers its rows
    from 1 and the manifest says what to add, so nothing is written twice for a
    lost race, and ids are unique and follow the order of commits.

    Commits that name a ``writer`` and its ``batch`` count once: the manifest
    remembers the last batch of each writer. ``compact`` writes one part of all,
    clips included; ``vacuum`` deletes what no recent manifest names.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = _Folder(spark, f"{self.path}/_manifest")

    def _load(self, version: str | None = None) -> dict:
        names = [n for n in self.manifests.names() if not n.startswith(".")]
        if not names:
            return {"version": 0, "last_id": 0, "parts": [], "clips": [], "writers": {}}
        return json.loads(self.manifests.read(version or names[-1]))

    def _commit(self, change: Callable[[dict], dict | None]) -> bool:
        """Claim the next version with ``change`` of the newest one, as often as others are faster."""
        while True:
            new = change(self._load())
            if new is None:
                return False
            new["version"] += 1
            if self.manifests.claim(f"{new['version']:018d}", json.dumps(new)):
                return True

    def _write(self, rows: DataFrame) -> dict:
        part = uuid.uuid4().hex
        where = f"{self.path}/parts/{part}"
        rows.repartition("stream_id", F.floor(F.col("timestamp") / 3600)).sortWithinPartitions(
            "stream_id", "zone_id", "timestamp").write.partitionBy("stream_id").parquet(where)
        empty = self.spark.read.schema(rows.schema).parquet(where)
        most, first, last = empty.agg(F.max("id"), F.min("timestamp"), F.max("timestamp")).first()
        return {"name": part, "ids": most or 0, "add": 0, "first": first, "last": last, "schema": rows.schema.json()}

    @staticmethod
    def _is_done(now: dict, writer: str | None, batch: int | None) -> bool:
        return writer is not None and now["writers"].get(writer, -1) >= batch

    def append(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> bool:
        """Add rows that ``record_violations`` or ``record_density_alerts`` numbered from 1; False if this batch is there already."""
        if self._is_done(self._load(), writer, batch):
            return False
        part = self._write(rows)

        def change(now: dict) -> dict | None:
            if self._is_done(now, writer, batch):
                return None
            mine = part | {"add": now["last_id"]}
            now["parts"] = [*now["parts"], mine] if part["ids"] else now["parts"]
            now["last_id"] += part["ids"]
            if writer is not None:
                now["writers"][writer] = batch
            return now

        return self._commit(change)

    def attach(self, clips: DataFrame) -> None:
        """Set ``clip_path`` and ``clip_url`` of the rows whose ``id`` is in ``clips``; later attachments replace earlier ones."""
        name = uuid.uuid4().hex
        clips.select("id", "clip_path", "clip_url").write.parquet(f"{self.path}/clips/{name}")
        self._commit(lambda now: now | {"clips": [*now["clips"], name]})

    def read(self, since: float | None = None, until: float | None = None) -> DataFrame | None:
        """All rows, or those with a ``timestamp`` from ``since`` and before ``until``; parts outside are not opened.

        None while the log is empty. Filters on camera, zone and time reach the files.
        """
        return self._rows(self._load(), since, until)

    def _rows(self, now: dict, since: float | None = None, until: float | None = None) -> DataFrame | None:
        parts = [p for p in now["parts"] if (since is None or p["last"] is None or p["last"] >= since)
                 and (until is None or p["first"] is None or p["first"] < until)] or now["parts"][:1]
        if not parts:
            return None
        found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self._part(p) for p in parts])
        wanted: list[Column] = []
        if since is not None:
            wanted.append(F.col("timestamp") >= since)
        if until is not None:
            wanted.append(F.col("timestamp") < until)
        for test in wanted:
            found = found.filter(test)
        if not now["clips"]:
            return found
        clips = reduce(DataFrame.unionByName, [
            self.spark.read.schema("id bigint, clip_path string, clip_url string").parquet(f"{self.path}/clips/{name}")
            .withColumn("at", F.lit(k)) for k, name in enumerate(now["clips"])])
        latest = clips.groupBy("id").agg(F.max(F.struct("at", "clip_path", "clip_url")).alias("c")).select("id", "c.clip_path", "c.clip_url")
        return attach_clip(found, latest)

    def _part(self, part: dict) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(part["schema"]))
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/parts/{part['name']}")
        return rows.select(*[(F.col(c) + part["add"]).alias(c) if c == "id" else F.col(c) for c in schema.names])

    def recent(self, zone_id: str | None = None, limit: int = 100) -> DataFrame | None:
        """The newest rows, as ``alertlog.recent`` gives them, from as many of the newest parts as hold enough."""
        now = self._load()
        bounds = sorted({p["first"] for p in now["parts"] if p["first"] is not None}, reverse=True)
        step = 1
        while step < len(bounds):
            found = recent(self._rows(now, since=bounds[step - 1]), zone_id, limit)
            if found.count() >= limit:
                return found
            step *= 4
        rows = self._rows(now)
        return None if rows is None else recent(rows, zone_id, limit)

    def compact(self) -> bool:
        """One part instead of all that there are now; commits made meanwhile stay beside it. False if there is nothing to do."""
        seen = self._load()
        if len(seen["parts"]) + len(seen["clips"]) < 2:
            return False
        rows = self._rows(seen)
        if rows is None:
            return False
        part = self._write(rows)

        def change(now: dict) -> dict | None:
            if now["parts"][:len(seen["parts"])] != seen["parts"] or now["clips"][:len(seen["clips"])] != seen["clips"]:
                return None  # somebody else has compacted
            now["parts"] = [part, *now["parts"][len(seen["parts"]):]]
            now["clips"] = now["clips"][len(seen["clips"]):]
            return now

        return self._commit(change)

    def vacuum(self, keep_versions: int = 10) -> None:
        """Delete manifests but the last ``keep_versions`` and the parts that none of these names.

        Not while writers are at work: a part that is written and not yet committed is named by none.
        """
        names = [n for n in self.manifests.names() if not n.startswith(".")]
        kept = [self._load(n) for n in names[-keep_versions:]]
        for folder, wanted in (
            ("parts", {p["name"] for m in kept for p in m["parts"]}), ("clips", {c for m in kept for c in m["clips"]}),
        ):
            files = _Folder(self.spark, f"{self.path}/{folder}")
            for name in set(files.names()) - wanted:
                files.delete(name)
        for name in names[:-keep_versions]:
            self.manifests.delete(name)


def alert_log_sink(path: str, record: Callable[[DataFrame], DataFrame], writer: str, compact_at: int = 64) -> Handler:
    """A handler that adds micro-batches to an ``AlertLog`` once each, and compacts it when it has ``compact_at`` parts.

    ``record`` is ``record_violations`` or ``record_density_alerts``; ``writer`` names the stream.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        log = AlertLog(batch.sparkSession, path)
        log.append(record(batch), writer, batch_id)
        if len(log._load()["parts"]) >= compact_at:
            log.compact()

    return write
