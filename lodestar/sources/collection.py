"""A durable collection of vectors: Parquet snapshots, Parquet logs of commits, and marker files that publish them.

``commits/<generation>.json`` is written last and by rename, so readers see whole commits; data without a
marker is ignored. One writer at a time. In memory (path None) the tables live in the session's shared folder
and are removed on close.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import vectors as V
from lodestar.functions.evaluation import contiguous_runs
from lodestar.operators import ivf, mutations, search
from lodestar.operators.predicate import ALL, Filter, eligible, page
from lodestar.operators.search import AUTO
from lodestar.sources import scratch

SCHEMA = "id long, user_id long, timestamp long, vector array<float>, live boolean, slot long"
LOG = "seq long, op string, id long, user_id long, timestamp long, vector array<float>, slot long, generation long"
BUDGET = 512 << 20
CHUNKS = 8
"""Folders of later rows that an index has at most before it is built anew."""


class CollectionError(Exception):
    """args[0] is the error's name: Closed, AlreadyExists, NotFound, CapacityExceeded, IndexNotPrepared, CommitUncertain, ..."""


@dataclass
class CommitReport:
    generation: int
    durable_generation: int
    mutations: int


@dataclass
class Report:
    """What a search did. What isn't known is None, and unavailable says why.

    Hits are a plan that nothing has run yet, so their number and the time aren't known; counts of eligible rows cost a
    job and are taken with set_diagnostics(True) only.
    """

    operation: str
    algorithm: str
    strategy: str
    generation: int
    index_generation: int | None
    rebuilt: bool
    preparation_reason: str | None
    batch_size: int
    k: int
    predicate: str
    routing_reason: str
    fallback_reason: str | None = None
    corpus_rows: int | None = None
    eligible_rows: int | None = None
    eligible_selectivity: float | None = None
    eligible_contiguous_runs: int | None = None
    results: int | None = None
    candidates: int | None = None
    total_duration: float | None = None
    upload_bytes: int | None = None
    readback_bytes: int | None = None
    unavailable: str = "no accelerator; hits are not run yet"


def route(eligible_rows: int | None, batch: int, profile: dict | None) -> tuple[str, str]:
    """The target that automatic routing would choose, and why: the processor for batches under 8 below the profile's least eligible rows, or without a profile."""
    if batch >= 8:
        return "accelerator", "batch of 8 and more"
    if not profile:
        return "processor", "no profile"
    if eligible_rows is None or eligible_rows < profile["minimum_eligible_rows"]:
        return "processor", "below the profile's minimum"
    return "accelerator", "profile"


class _Files:
    """The few file operations that markers need, on any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        p = self._path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def put(self, name: str, text: str) -> None:
        pending = self._path(f"{name}.pending")
        out = self.fs.create(pending, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(pending, self._path(name)):
            raise CollectionError("CommitUncertain")

    def get(self, name: str) -> str:
        at = self.fs.open(self._path(name))
        try:
            return bytes(at.readAllBytes()).decode()
        finally:
            at.close()

    def drop(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength()


def _crc(mark: dict) -> int:
    return zlib.crc32(json.dumps({k: v for k, v in sorted(mark.items()) if k != "crc"}).encode())


class Collection:
    def __init__(self, spark: SparkSession, path: str | None, dimension: int, budget: int = BUDGET):
        """Use new, create, open or import_portable."""
        if dimension <= 0:
            raise CollectionError("ZeroDimension")
        self.spark, self.dimension, self.budget, self.durable = spark, dimension, budget, path is not None
        if path is None:
            path = scratch.folder(spark, "collection")
        self.path, self.files = path.rstrip("/"), _Files(spark, path)
        self.closed, self.uncertain, self.generation, self.explicit, self.detailed = False, False, 0, False, False
        self.index: tuple[int, ivf.Index] | None = None
        self.opened, self.reason, self.rebuilt = False, None, False
        self.ivf: dict | None = None
        self._state: DataFrame | None = None
        self.profile: dict | None = None

    # opening and closing
    @classmethod
    def new(cls, spark: SparkSession, dimension: int, budget: int = BUDGET) -> Collection:
        return cls(spark, None, dimension, budget)._start()

    @classmethod
    def create(cls, spark: SparkSession, path: str, dimension: int, budget: int = BUDGET) -> Collection:
        out = cls(spark, path, dimension, budget)
        if out.files.names(""):
            raise CollectionError("AlreadyExists")
        return out._start()

    def _start(self) -> Collection:
        self._mark({"kind": "start", "generation": 0, "rows": 0, "live": 0})
        return self

    @classmethod
    def open(cls, spark: SparkSession, path: str, dimension: int | None = None, budget: int = BUDGET) -> Collection:
        """The newest snapshot and the logs after it, which must follow one another without a gap."""
        out = cls(spark, path, dimension or 1, budget)
        marks = out._marks()
        if not marks:
            raise CollectionError("NotFound")
        if dimension is not None and marks[0]["dimension"] != dimension:
            raise CollectionError("DimensionMismatch")
        out.dimension = marks[0]["dimension"]
        snapshot, _ = out._live_marks(marks)
        if snapshot and spark.read.schema(SCHEMA).parquet(f"{out.path}/{snapshot['data']}").count() != snapshot["rows"]:
            raise CollectionError("Corrupt")  # Parquet footers tell the count
        out.generation, out.opened = max(m["generation"] for m in marks), True
        return out

    @classmethod
    def import_portable(cls, spark: SparkSession, source: str, path: str | None = None, budget: int = BUDGET, magic: bytes | None = None) -> Collection:
        """A portable file, which the driver reads in batches; stored vectors are kept to the bit."""
        import pyarrow as pa

        from lodestar.sources import portable

        head, batches = portable.read(source, magic=magic)
        out = cls(spark, path, head["dimension"], budget)
        if path is not None and out.files.names(""):
            raise CollectionError("AlreadyExists")
        out._admit(head["rows"])
        out._start()
        name = f"data/snapshot-{head['generation']}-{uuid.uuid4().hex}"
        empty = True
        for batch in batches:
            spark.createDataFrame(pa.Table.from_batches([batch])).select("id", "user_id", "timestamp", F.col("vector").cast("array<float>"), "live", "slot").write.mode("append").parquet(f"{out.path}/{name}")
            empty = False
        if empty:
            spark.createDataFrame([], SCHEMA).write.parquet(f"{out.path}/{name}")
        out._mark({"kind": "snapshot", "data": name, "generation": head["generation"], "rows": head["rows"], "live": head["live"]})
        out.generation = head["generation"]
        return out

    def close(self) -> None:
        if not self.closed and not self.durable:
            self.files.drop("")
        self.closed, self._state = True, None

    def _check(self) -> None:
        if self.closed or self.uncertain:
            raise CollectionError("Closed")

    # markers
    def _mark(self, mark: dict) -> None:
        mark |= {"dimension": self.dimension, "version": 1}
        mark["crc"] = _crc(mark)
        try:
            self.files.put(f"commits/{mark['generation']:020d}-{mark['kind']}.json", json.dumps(mark))
        except Exception as e:
            self.uncertain = True
            raise CollectionError("CommitUncertain") from e
        self._state = None

    def _marks(self) -> list[dict]:
        out = [json.loads(self.files.get(f"commits/{n}")) for n in self.files.names("commits") if n.endswith(".json")]
        if any(m["version"] != 1 for m in out):
            raise CollectionError("UnsupportedVersion")
        if any(m.pop("crc", None) != _crc(m) for m in out):
            raise CollectionError("Corrupt")
        return sorted(out, key=lambda m: (m["generation"], m["kind"] == "snapshot"))

    def _live_marks(self, marks: list[dict]) -> tuple[dict | None, list[dict]]:
        snapshot = max((m for m in marks if m["kind"] == "snapshot"), key=lambda m: m["generation"], default=None)
        at = snapshot["generation"] if snapshot else 0
        logs = [m for m in marks if m["kind"] == "log" and m["generation"] > at]
        for m in logs:
            if m["from"] != at:
                raise CollectionError("Corrupt")
            at = m["generation"]
        return snapshot, logs

    def records(self) -> DataFrame:
        """All rows, deleted ones too: the snapshot and the added rows, less the deletions of the logs."""
        self._check()
        if self._state is None:
            snapshot, logs = self._live_marks(self._marks())
            rows = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{snapshot['data']}") if snapshot else self.spark.createDataFrame([], SCHEMA)
            if logs:
                log = self.spark.read.schema(LOG).parquet(*[f"{self.path}/{m['data']}" for m in logs])
                added = log.where(F.col("op") == mutations.ADD).select("id", "user_id", "timestamp", "vector", F.lit(True).alias("live"), "slot")
                gone = log.where(F.col("op") == mutations.DELETE).select("id", F.lit(True).alias("_gone"))
                rows = rows.unionByName(added).join(gone, "id", "left")
                rows = rows.select("id", "user_id", "timestamp", "vector", (F.col("live") & F.col("_gone").isNull()).alias("live"), "slot")
            self._state = rows
        return self._state

    # mutations
    def add_buffer(self, vectors, ids, user_ids=None, timestamps=None) -> CommitReport:
        """A matrix of floats, a row for each id, with owners and times (0 without), as one commit; columns go over as Arrow."""
        import numpy as np
        import pyarrow as pa

        matrix, ids = np.asarray(vectors), np.asarray(ids)
        if matrix.dtype != np.float32 or matrix.ndim != 2 or not matrix.flags.c_contiguous:
            raise ValueError("vectors must be a contiguous matrix of 32-bit floats")
        if matrix.shape[1] != self.dimension:
            raise CollectionError("DimensionMismatch")
        others = [np.zeros(len(ids), np.int64) if x is None else np.asarray(x) for x in (user_ids, timestamps)]
        if any(len(x) != len(matrix) for x in (ids, *others)):
            raise ValueError("columns differ in length")
        n = len(matrix)
        if not n:
            return CommitReport(self.generation, self.generation, 0)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * self.dimension + 1, self.dimension, dtype=np.int32)), pa.array(matrix.ravel()))
        columns = {"seq": np.arange(n), "op": pa.array([mutations.ADD] * n), "id": ids.astype(np.int64), "user_id": others[0].astype(np.int64), "timestamp": others[1].astype(np.int64), "vector": flat}
        return self.commit_table(self.spark.createDataFrame(pa.table(columns)))

    def add(self, id: int, user_id: int, timestamp: int, vector: Sequence[float]) -> CommitReport:
        return self.commit([(mutations.ADD, id, user_id, timestamp, list(vector))])

    def delete(self, id: int) -> CommitReport:
        return self.commit([(mutations.DELETE, id, None, None, None)])

    def add_batch(self, rows: Iterable[tuple]) -> CommitReport:
        return self.commit([(mutations.ADD, *r) for r in rows])

    def delete_batch(self, ids: Iterable[int]) -> CommitReport:
        return self.commit([(mutations.DELETE, i, None, None, None) for i in ids])

    def commit(self, batch: list[tuple]) -> CommitReport:
        """An ordered batch of (op, id, user_id, timestamp, vector), all or nothing."""
        self._check()
        if not batch:
            return CommitReport(self.generation, self.generation, 0)
        rows = [(i, op, n, u, t, None if v is None else [float(x) for x in v]) for i, (op, n, u, t, v) in enumerate(batch)]
        return self.commit_table(self.spark.createDataFrame(rows, "seq long, op string, id long, user_id long, timestamp long, vector array<float>"))

    def validate_batch(self, batch: DataFrame):
        """(seq, error) of the first illegal mutation, or None, without applying anything."""
        bad = batch.withColumn("_p", F.when(F.col("op") == mutations.ADD, V.problem(F.col("vector"), self.dimension))).where("_p is not null").orderBy("seq").select("seq", "_p").first()
        order = mutations.first_error(batch, self.records().select("id", "live"))
        found = [x for x in (None if bad is None else tuple(bad), order) if x is not None]
        return min(found) if found else None

    def commit_table(self, batch: DataFrame, stream: int | None = None) -> CommitReport:
        """The same for a table (seq, op, id, user_id, timestamp, vector) of any size; seq gives the order.

        The batch is written once and read again for the checks. stream: the number of a stream's batch; the marker
        that publishes the commit holds it, so a batch that comes again after any failure changes nothing.
        """
        self._check()
        if stream is not None and stream <= self._last()["stream"]:
            return CommitReport(self.generation, self.generation, 0)
        incoming = f"data/incoming-{uuid.uuid4().hex}"
        batch.write.parquet(f"{self.path}/{incoming}")
        try:
            return self._commit(self.spark.read.schema(batch.schema).parquet(f"{self.path}/{incoming}"), stream)
        finally:
            self.files.drop(incoming)

    def _last(self) -> dict:
        """Rows, and the number of the last batch of a stream, from the markers."""
        marks = self._marks()
        return {"rows": marks[-1].get("rows"), "stream": max((m.get("stream", -1) for m in marks), default=-1)}

    def _commit(self, batch: DataFrame, stream: int | None) -> CommitReport:
        if error := self.validate_batch(batch):
            raise CollectionError(error[1], error[0])
        count, adding = batch.agg(F.count("*"), F.count_if(F.col("op") == mutations.ADD)).first()
        if not count:
            return CommitReport(self.generation, self.generation, 0)
        try:
            generation = mutations.next_generation(self.generation, count)
        except ValueError as e:
            raise CollectionError("GenerationExhausted") from e
        last = self._last()
        base = self.records().count() if last["rows"] is None else last["rows"]
        added = batch.where(F.col("op") == mutations.ADD)
        self._admit(base + adding)
        adds = mutations.with_slots(added.withColumn("vector", V.normalized(F.col("vector"))), base)
        log = adds.unionByName(batch.where(F.col("op") == mutations.DELETE).withColumn("slot", F.lit(None).cast("long")))
        name = f"data/log-{generation}-{uuid.uuid4().hex}"
        log.withColumn("generation", F.lit(generation)).select([c.split()[0] for c in LOG.split(", ")]).write.parquet(f"{self.path}/{name}")
        self._mark({"kind": "log", "data": name, "from": self.generation, "generation": generation, "rows": base + adding} | ({} if stream is None else {"stream": stream}))
        self.generation = generation
        return CommitReport(generation, generation, count)

    def _admit(self, rows: int) -> None:
        if rows >= 2**32 or rows * (32 + 4 * self.dimension + 512) > self.budget:
            raise CollectionError("CapacityExceeded")

    # reads
    def filter(self, where: Filter = ALL) -> DataFrame:
        """Ids of eligible rows in slot order; nothing after close."""
        if self.closed:
            return self.spark.createDataFrame([], "id long")
        return eligible(self.records(), where).select("slot", "id").orderBy("slot").select("id")

    def filter_count(self, where: Filter = ALL) -> int:
        return eligible(self.records(), where).count()

    def get_record(self, id: int):
        """The row, deleted or not, or None."""
        return None if self.closed else self.records().where(F.col("id") == id).first()

    def record(self, slot: int):
        """The row in a slot, deleted or not, or None."""
        return None if self.closed else self.records().where(F.col("slot") == slot).first()

    def slot_of(self, id: int) -> int | None:
        row = self.get_record(id)
        return None if row is None else row["slot"]

    def scan_records(self, offset: int = 0, limit: int = 50, where: Filter | None = None) -> tuple[DataFrame, int]:
        if self.closed:
            return self.spark.createDataFrame([], SCHEMA), 0
        if offset < 0 or limit < 0:
            raise ValueError("InvalidPage")
        rows, total = page(self.records(), offset, limit, where)
        return rows, total.first()[0]

    def canonical_snapshot(self, where: Filter = ALL) -> tuple[DataFrame, int]:
        """Live matching rows and the generation that they belong to."""
        return eligible(self.records(), where), self.generation

    def in_slot_order(self) -> DataFrame:
        """All rows, deleted ones too, in the order of their slots."""
        return self.records().orderBy("slot")

    def stats(self) -> dict:
        rows, live = (0, 0) if self.closed else self.records().agg(F.count("*"), F.count_if("live")).first()
        return {"rows": rows, "live_rows": live, "tombstones": rows - live, "dimension": self.dimension, "generation": self.generation, "closed": self.closed, "durable": self.durable}

    # search
    def prepare(self) -> None:
        """Builds what the chosen search needs for this generation."""
        self._check()
        if self.ivf and (self.index is None or self.index[0] != self.generation):
            self.reason, found = self._why()
            self.rebuilt = False
            if found is None and self.reason in ("Mutation", "StaleIndex"):
                found = self._updated()
            if found is None:
                self._drop_index()
                self.rebuilt, place = True, f"index/{uuid.uuid4().hex}"
                found = ivf.build(self.records(), self.ivf["lists"], f"{self.path}/{place}")
                self._mark_index([place], found.centroids)
            self.index = (self.generation, found)

    def _mark_index(self, data: list[str], centroids) -> None:
        mark = {"dimension": self.dimension, "generation": self.generation, "lists": self.ivf["lists"], "rows": self.records().count(), "data": data, "centroids": centroids.tolist()}
        self.files.drop("index/marker.json")  # the index can be made again, so a moment without one does no harm
        self.files.put("index/marker.json", json.dumps(mark | {"crc": _crc(mark)}))

    def _index_mark(self) -> dict | None:
        """The marker of the stored index; None if it, or what it names, is damaged."""
        try:
            mark = json.loads(self.files.get("index/marker.json"))
            there = self.files.names("index")
            good = mark.pop("crc", None) == _crc(mark) and mark["dimension"] == self.dimension and all(p.split("/")[1] in there for p in mark["data"])
        except (ValueError, KeyError):
            good = False
        return mark if good else None

    def _stored(self, mark: dict) -> ivf.Index:
        import numpy as np

        return ivf.Index(np.array(mark["centroids"], np.float32), tuple(f"{self.path}/{p}" for p in mark["data"]), self.records().where("not live").select("id"))

    def _updated(self) -> ivf.Index | None:
        """The stored index with the rows that came since, in a folder of their own, and without those deleted since.

        None, so that all is built anew, after CHUNKS such folders, or if over a quarter of the rows are new.
        """
        mark = self._index_mark()
        if mark is None or mark["lists"] != self.ivf["lists"] or len(mark["data"]) > CHUNKS or not mark["centroids"]:
            return None
        more = self.records().where(F.col("slot") >= mark["rows"])
        n = more.count()
        if 4 * n > mark["rows"]:
            return None
        import numpy as np

        data, centroids = mark["data"], np.array(mark["centroids"], np.float32)
        if n:
            place = f"index/{uuid.uuid4().hex}"
            ivf.store(more, centroids, f"{self.path}/{place}")
            data = [*data, place]
        self._mark_index(data, centroids)
        return ivf.Index(centroids, tuple(f"{self.path}/{p}" for p in data), self.records().where("not live").select("id"))

    def _drop_index(self) -> None:
        self.files.drop("index")

    def _why(self) -> tuple[str | None, ivf.Index | None]:
        """Why the index must be made: Initial, Mutation, MissingIndex, CorruptIndex, StaleIndex; or the stored one, with Restart."""
        if self.index is not None:
            return "Mutation", None
        if "marker.json" not in self.files.names("index"):
            return ("MissingIndex" if self.opened else "Initial"), None
        mark = self._index_mark()
        if mark is None:
            return "CorruptIndex", None
        if (mark["generation"], mark["lists"]) != (self.generation, self.ivf["lists"]):
            return "StaleIndex", None
        return "Restart", self._stored(mark)

    def _ready(self) -> bool:
        if not self.ivf or (self.index is not None and self.index[0] == self.generation):
            return False
        if self.explicit:
            raise CollectionError("IndexNotPrepared")
        self.prepare()
        return True

    def search(self, query: Sequence[float], where: Filter = ALL, k: int = 10, strategy: str = AUTO) -> tuple[DataFrame, Report]:
        """The hits, and a report of what was done."""
        hits, reports = self.search_batch([query], where, k, strategy)
        return hits.drop("query_id"), reports[0] if reports else None

    def search_batch(self, queries: list[Sequence[float]], where: Filter = ALL, k: int = 10, strategy: str = AUTO) -> tuple[DataFrame, list[Report]]:
        """query_id (position), rank, id, distance. No queries: nothing is checked and nothing returned."""
        if not queries:
            return self.spark.createDataFrame([], "query_id long, rank int, id long, distance float"), []
        self._check()
        V.check_k(k)
        search.check_strategy(strategy)
        units = [(i, V.validate(q, self.dimension)) for i, q in enumerate(queries)]
        rebuilt, table = self._ready(), self.spark.createDataFrame(units, "query_id long, query array<float>")
        if self.ivf:
            hits = ivf.search(self.index[1], self.records(), table, k, self.ivf["nprobe"], where, self.ivf["codes"], union=len(queries) > 1)
        else:
            hits = search.batch_top_k(self.records(), table, k, where, strategy)
        facts: dict = {}
        if self.detailed:
            corpus, count = self.records().agg(F.count("*"), F.count_if(where.live())).first()
            runs = contiguous_runs(eligible(self.records(), where)).first()[0]
            facts = {"corpus_rows": corpus, "eligible_rows": count, "eligible_selectivity": count / corpus if corpus else 0.0, "eligible_contiguous_runs": runs}
        target, why = route(facts.get("eligible_rows"), len(queries), self.profile)
        fallback = None if target == "processor" else "no accelerator"
        used = "ivf" if self.ivf else search.BLOCK if strategy == search.AUTO else strategy
        report = Report(uuid.uuid4().hex, "approximate" if self.ivf else "exact", used, self.generation, self.index[0] if self.ivf else None, rebuilt and self.rebuilt, self.reason if rebuilt else None, len(queries), k, where.kind(), f"{target}: {why}", fallback, **facts)
        return hits, [report for _ in queries]

    # options
    def set_rebuild_policy(self, explicit: bool) -> None:
        self.explicit = explicit

    def set_diagnostics(self, detailed: bool) -> None:
        self.detailed = detailed

    def set_ivf(self, lists: int | None, nprobe: int = 1, codes: bool = False) -> None:
        """Approximate search by inverted lists; None goes back to exact search."""
        if lists is not None:
            ivf.check(nprobe, lists)
        self.ivf, self.index = None if lists is None else {"lists": lists, "nprobe": nprobe, "codes": codes}, None

    def set_search_expansion(self, nprobe: int) -> None:
        if self.ivf is None or nprobe < 1:
            raise CollectionError("BackendNotEnabled" if self.ivf is None else "InvalidIvfConfig")
        ivf.check(nprobe, self.ivf["lists"])
        self.ivf["nprobe"] = nprobe

    def set_router_profile(self, profile: dict | None) -> None:
        """profile: minimum_eligible_rows, from which on automatic routing prefers an accelerator. Here it only changes the report."""
        if profile is not None and profile.get("minimum_eligible_rows", -1) < 0:
            raise CollectionError("InvalidProfile")
        self.profile = profile

    def set_row_preparation(self, mode: str) -> None:
        """A hint without effect here: all modes give the same results."""

    def set_select_kernel(self, mode: str) -> None:
        """A hint without effect here: all kernels give the same results."""

    def device_capabilities(self) -> None:
        return None

    # durability
    def flush(self) -> None:
        """A snapshot of this generation, sorted by owner and time for pruning; older logs and all but the previous snapshot go."""
        self._check()
        marks = self._marks()
        snapshot, logs = self._live_marks(marks)
        if not logs:
            return
        name = f"data/snapshot-{self.generation}-{uuid.uuid4().hex}"
        self.records().repartitionByRange("user_id", "timestamp").sortWithinPartitions("user_id", "timestamp").write.parquet(f"{self.path}/{name}")
        rows, live = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{name}").agg(F.count("*"), F.count_if("live")).first()
        stream = self._last()["stream"]
        self._mark({"kind": "snapshot", "data": name, "generation": self.generation, "rows": rows, "live": live, "digest": self._digest(name)} | ({} if stream < 0 else {"stream": stream}))
        keep = snapshot["generation"] if snapshot else -1
        for m in marks:
            if m["kind"] == "log" and m["generation"] <= keep or m["kind"] == "snapshot" and m["generation"] < keep:
                self.files.drop(f"commits/{m['generation']:020d}-{m['kind']}.json")
                self.files.drop(m["data"])

    def verify(self) -> None:
        """Reads the newest snapshot whole and compares the sum of its rows' hashes with its marker's; Corrupt if they differ."""
        self._check()
        snapshot, _ = self._live_marks(self._marks())
        if snapshot and "digest" in snapshot and self._digest(snapshot["data"]) != snapshot["digest"]:
            raise CollectionError("Corrupt")

    def _digest(self, name: str) -> str:
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{name}")
        return str(rows.agg(F.sum(F.xxhash64(*rows.columns).cast("decimal(20,0)"))).first()[0])

    def export_portable(self, target: str, magic: bytes | None = None) -> None:
        """All rows in slot order into one new local file, one partition at a time."""
        import pyarrow as pa

        from lodestar.sources import portable

        s = self.stats()
        rows = self.records().select("id", "user_id", "timestamp", "live", "vector", "slot").orderBy("slot").drop("slot")

        def batches():
            held = []
            for r in rows.toLocalIterator():
                held.append(r)
                if len(held) == 8192:
                    yield make(held)
                    held = []
            if held:
                yield make(held)

        def make(held):
            columns = list(zip(*held, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.float32()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "user_id", "timestamp", "live", "vector"])

        portable.write(target, self.dimension, self.generation, s["rows"], s["live_rows"], batches(), magic or portable.MAGIC)

    def storage(self) -> list[tuple[str, str, int]]:
        """(name, kind, bytes) of the files, by name."""
        out = [(f"commits/{n}", n.split("-")[1].removesuffix(".json"), self.files.size(f"commits/{n}")) for n in self.files.names("commits")]
        return sorted(out + [(f"data/{n}", n.split("-")[0], self.files.size(f"data/{n}")) for n in self.files.names("data")])


def described(report: Report) -> str:
    return json.dumps(asdict(report))


MAX_PAGE = 500


class View:
    """Reads with defaults for a program that serves people: pages of 50, 500 at most; k is moved into its range, not refused."""

    def __init__(self, collection: Collection):
        self.collection = collection

    def records(self, offset: int = 0, limit: int = 50, user_id: int | None = None, lower: int | None = None, upper: int | None = None) -> tuple[DataFrame, int]:
        given = (user_id, lower, upper)
        return self.collection.scan_records(offset, min(limit, MAX_PAGE), None if given == (None, None, None) else Filter(*given))

    def search(self, query: Sequence[float], k: int = 10, **filters) -> DataFrame:
        return self.collection.search(query, Filter(filters.get("user_id"), filters.get("lower"), filters.get("upper")), min(max(k, 1), V.MAX_K))[0]


class Snapshot:
    """The rows that match a filter at one generation; refuses to serve once the collection has moved on."""

    def __init__(self, collection: Collection, where: Filter = ALL):
        self.collection, (self._rows, self.generation) = collection, collection.canonical_snapshot(where)

    def rows(self) -> DataFrame:
        if self.collection.closed or self.collection.generation != self.generation:
            raise CollectionError("StaleSnapshot")
        return self._rows

    def search(self, queries: list[Sequence[float]], k: int) -> DataFrame:
        units = [(i, V.validate(q, self.collection.dimension)) for i, q in enumerate(queries)]
        return search.batch_top_k(self.rows().withColumn("live", F.lit(True)), self.collection.spark.createDataFrame(units, "query_id long, query array<float>"), k)


def catalog(spark: SparkSession, text: str = "") -> DataFrame:
    """name, kind, summary of the public functions of this package that have the text in one of the three, any case."""
    import importlib
    import inspect

    rows = []
    for name in ("functions.vectors", "functions.evaluation", "functions.generators", "operators.search", "operators.ivf", "operators.predicate", "operators.mutations"):
        module = importlib.import_module(f"lodestar.{name}")
        rows += [(n, name, (inspect.getdoc(f) or "").split("\n")[0]) for n, f in sorted(vars(module).items()) if inspect.isfunction(f) and f.__module__ == module.__name__ and n[0] != "_"]
    found = spark.createDataFrame(rows, "name string, kind string, summary string")
    wanted = F.lower(F.lit(text))
    return found.where(F.contains(F.lower("name"), wanted) | F.contains(F.lower("kind"), wanted) | F.contains(F.lower("summary"), wanted)).orderBy("name")
