"""Files of evaluation runs, prepared datasets, and the collection's index, reports, views, streams and limits."""

import datetime
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators.predicate import Filter
from lodestar.sources import dataset, tables
from lodestar.sources.collection import MAX_PAGE, Collection, CollectionError, Snapshot, View, catalog, route
from lodestar.streaming import changelog


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("tuning", 0, [3, 1]), ("evaluation", 1, []), ("evaluation", None, [9])], "split string, query_index long, ids array<long>")
    at = tables.write_result(df, str(tmp_path), "truth")
    got = tables.read_csv(spark, at, tables.TRUTH_COLUMNS).collect()
    assert sorted((r.split, r.query_index, r.ids) for r in got if r.query_index is not None) == [("evaluation", 1, None), ("tuning", 0, "3;1")]
    with pytest.raises(ValueError, match="UnknownResult"):
        tables.write_result(df, str(tmp_path), "others")
    with pytest.raises(Exception, match="header|schema|conform"):
        tables.read_csv(spark, at, "other string, query_index long, ids string").collect()
    (tmp_path / "t.tsv").write_text("a\tb\n1\t\n2\tx=y\n")
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "t.tsv"), "a int, b string", "\t").orderBy("a").collect()] == [(1, None), (2, "x=y")]


def test_properties_and_records(spark, tmp_path):
    at = tables.write_summary(spark, {"k": 10, "path": "a=b", "none": None}, str(tmp_path))
    assert tables.read_properties(spark, at).first().properties == {"k": "10", "path": "a=b", "none": ""}
    (tmp_path / "p.txt").write_text("\nx=1\r\nnot a pair\ny = 2 \nx=3\n")
    assert tables.read_properties(spark, str(tmp_path / "p.txt")).first().properties == {"x": "3", "y": "2"}
    (tmp_path / "r.json").write_text(json.dumps([{"a": 1, "b": "x", "c": 0}, {"a": None, "b": "y"}]))
    assert [tuple(r) for r in tables.read_records(spark, str(tmp_path / "r.json"), "a int, b string").collect()] == [(1, "x"), (None, "y")]


def test_run_store(spark, tmp_path):
    store = tables.RunStore(spark, f"{tmp_path}/runs")
    at = lambda s: datetime.datetime(2026, 1, 1, 0, 0, s)
    store.insert(spark.createDataFrame([("a", at(1), "{}"), ("b", at(2), '{"x": 1}')], tables.RUN))
    store.insert(spark.createDataFrame([("a", at(3), '{"y": 2}')], tables.RUN))
    assert [(r.run_id, r.payload) for r in store.latest().collect()] == [("a", '{"y": 2}'), ("b", '{"x": 1}')]
    assert store.latest(1).count() == 1 and store.read("b").payload == '{"x": 1}' and store.read("c") is None


def test_dataset(spark, tmp_path):
    at = f"{tmp_path}/d.bin"
    head = dataset.prepare(at, 8, 100, 5, 7, seed=3)
    got = dataset.load(spark, at)
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"corpus": 100, "tuning": 5, "evaluation": 7}
    assert got.where(F.abs(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x) - 1) > 1e-5).isEmpty() and head.rows == 112
    with pytest.raises(FileExistsError):
        dataset.prepare(at, 8, 1, 1, 1)
    raw = open(at, "rb").read()
    for rule, bad in {"Checksum": raw[:60] + bytes([raw[60] ^ 1]) + raw[61:], "Length": raw[:-9], "Magic": b"NOTMAGIC" + raw[8:]}.items():
        with pytest.raises(dataset.Damaged, match=rule):
            dataset.check(bad)
    with pytest.raises(dataset.Damaged, match="Budget"):
        dataset.check(raw, 100)
    values = np.random.default_rng(1).normal(size=(9, 4)).astype("<f4")
    (tmp_path / "raw").write_bytes(values.tobytes())
    import zlib

    dataset.import_raw(f"{tmp_path}/raw", f"{tmp_path}/e.bin", 4, 6, 1, 2, zlib.crc32(values.tobytes()))
    first = dataset.load(spark, f"{tmp_path}/e.bin").where("split = 'corpus' and id = 0").first().vector
    assert first == pytest.approx((values[0] / np.linalg.norm(values[0])).tolist(), abs=1e-6)
    with pytest.raises(dataset.Damaged, match="Checksum"):
        dataset.import_raw(f"{tmp_path}/raw", f"{tmp_path}/f.bin", 4, 6, 1, 2, 1)
    assert not os.path.exists(f"{tmp_path}/f.bin")


@pytest.fixture
def filled(spark, tmp_path):
    c = Collection.create(spark, f"{tmp_path}/c", 4)
    rng = np.random.default_rng(2)
    c.add_buffer(rng.normal(size=(300, 4)).astype(np.float32), np.arange(300), user_ids=np.arange(300) % 5, timestamps=np.arange(300))
    return c


def test_bulk_columns(spark, filled):
    assert filled.generation == 300 and filled.stats()["live_rows"] == 300 and filled.slot_of(7) == 7 and filled.record(7)["user_id"] == 2
    with pytest.raises(ValueError, match="32-bit"):
        filled.add_buffer(np.zeros((1, 4)), [900])
    with pytest.raises(CollectionError, match="DimensionMismatch"):
        filled.add_buffer(np.ones((1, 3), np.float32), [900])
    with pytest.raises(CollectionError, match="DuplicateId"):
        filled.add_buffer(np.ones((2, 4), np.float32), [900, 900])
    assert filled.add_buffer(np.zeros((0, 4), np.float32), []).mutations == 0 and filled.generation == 300


def test_reports(filled):
    with pytest.raises(ValueError, match="UnknownStrategy"):
        filled.search([1, 2, 3, 4], strategy="nonsense")
    filled.set_diagnostics(True)
    want = None
    for strategy in ("reference", "block", "int8", "auto"):
        hits, report = filled.search([1, 2, 3, 4], Filter(2), 10, strategy)
        assert report.strategy == ("block" if strategy == "auto" else strategy) and report.algorithm == "exact"
        assert (report.corpus_rows, report.eligible_rows, report.eligible_selectivity, report.eligible_contiguous_runs) == (300, 60, 0.2, 60)
        assert report.results is None and report.unavailable and report.routing_reason == "processor: no profile"
        got = sorted(map(tuple, hits.collect()))
        assert want in (None, got)
        want = got
    assert route(10, 8, None)[0] == "accelerator" and route(10, 1, {"minimum_eligible_rows": 11})[0] == "processor" and route(11, 1, {"minimum_eligible_rows": 11})[0] == "accelerator"
    filled.set_router_profile({"minimum_eligible_rows": 1})
    assert filled.search([1, 2, 3, 4])[1].fallback_reason == "no accelerator"


def test_stored_index(spark, filled):
    def reason(c):
        c.set_ivf(8, 8)
        hits, report = c.search([1, 2, 3, 4], k=5)
        assert report.algorithm == "approximate" and len(hits.collect()) == 5 and report.index_generation == c.generation
        return report.preparation_reason

    assert reason(filled) == "Initial"
    filled.delete(3)
    hits, report = filled.search([1, 2, 3, 4], k=64)
    assert report.preparation_reason == "Mutation" and 3 not in {r.id for r in hits.collect()}
    assert reason(Collection.open(spark, filled.path)) == "Restart"
    assert not report.rebuilt  # one deletion is taken from the stored rows
    filled.add(1000, 1, 1, [1, 2, 3, 4])
    hits, report = filled.search([1, 2, 3, 4], k=64)
    assert not report.rebuilt and {1000} <= {r.id for r in hits.collect()} and len(filled.files.names("index")) == 3
    exact = Collection.open(spark, filled.path).search([1, 2, 3, 4], k=64)[0].collect()
    assert [(r.rank, r.id) for r in sorted(hits.collect(), key=lambda r: r.rank)] == [(r.rank, r.id) for r in sorted(exact, key=lambda r: r.rank)]
    filled.delete(4)
    assert reason(Collection.open(spark, filled.path)) == "StaleIndex"
    marker = f"{filled.path}/index/marker.json"
    text = open(marker).read()
    open(marker, "w").write(text.replace('"lists": 8', '"lists": 7'))
    crc = f"{filled.path}/index/.marker.json.crc"
    if os.path.exists(crc):
        os.unlink(crc)
    assert reason(Collection.open(spark, filled.path)) == "CorruptIndex"
    os.unlink(marker)
    assert reason(Collection.open(spark, filled.path)) == "MissingIndex"


def test_index_is_built_anew_after_many_rows(filled):
    filled.set_ivf(8, 8)
    filled.search([1, 2, 3, 4])
    rng = np.random.default_rng(5)
    filled.add_buffer(rng.normal(size=(100, 4)).astype(np.float32), np.arange(2000, 2100))
    assert filled.search([1, 2, 3, 4])[1].rebuilt and len(filled.files.names("index")) == 2


def test_damaged_marker(spark, filled):
    name = next(n for n in os.listdir(f"{filled.path}/commits") if n.endswith("log.json"))
    at = f"{filled.path}/commits/{name}"
    text = open(at).read()
    open(at, "w").write(text.replace('"rows": 300', '"rows": 299'))
    os.unlink(f"{filled.path}/commits/.{name}.crc")
    with pytest.raises(CollectionError, match="Corrupt"):
        Collection.open(spark, filled.path)


def test_views_and_snapshots(filled, spark):
    view = View(filled)
    rows, total = view.records(limit=10_000)
    assert rows.count() == 300 < MAX_PAGE and total == 300 and view.records(user_id=1)[1] == 60
    assert view.search([1, 2, 3, 4], k=0).count() == 1 and view.search([1, 2, 3, 4], k=1000).count() == 64
    own = Snapshot(filled, Filter(1))
    assert own.rows().count() == 60 and own.search([[1, 2, 3, 4]], 3).count() == 3
    filled.delete(1)
    with pytest.raises(CollectionError, match="StaleSnapshot"):
        own.rows()
    assert {"top_k", "batch_top_k"} <= {r.name for r in catalog(spark, "TOP_K").collect()}


def test_portable_is_healed_and_snapshots_are_verified(spark, filled, tmp_path):
    from lodestar.sources import portable

    at = f"{tmp_path}/whole"
    filled.export_portable(at)
    os.rename(at, f"{at}.pending")
    assert portable.read(at)[0]["rows"] == 300 and os.path.exists(at) and not os.path.exists(f"{at}.pending")
    with pytest.raises(portable.Damaged, match="magic"):
        portable.read(at, magic=b"OTHERS1\0")
    assert portable.read(at, magic=None)[0]["generation"] == 300
    os.rename(at, f"{at}.pending")
    with open(f"{at}.pending", "r+b") as f:
        f.seek(100)
        f.write(b"?")
    with pytest.raises(FileNotFoundError):
        portable.read(at)
    filled.flush()
    filled.verify()
    data = f"{filled.path}/" + next(m for m in filled._marks() if m["kind"] == "snapshot")["data"]
    rows = spark.read.parquet(data)
    rows.withColumn("user_id", F.col("user_id") + 1).write.mode("overwrite").parquet(f"{data}-other")
    os.rename(data, f"{data}-old")
    os.rename(f"{data}-other", data)
    with pytest.raises(CollectionError, match="Corrupt"):
        filled.verify()
    os.rename(data, f"{data}-changed")
    rows_of = spark.read.parquet(f"{data}-old").where("id > 5")
    rows_of.write.parquet(data)
    with pytest.raises(CollectionError, match="Corrupt"):
        Collection.open(spark, filled.path)


def test_capacity(spark, tmp_path):
    c = Collection.create(spark, f"{tmp_path}/small", 4, budget=2 * (32 + 16 + 512))
    c.add_batch([(1, 1, 1, [1.0, 0, 0, 0]), (2, 1, 1, [1.0, 0, 0, 0])])
    with pytest.raises(CollectionError, match="CapacityExceeded"):
        c.add(3, 1, 1, [1.0, 0, 0, 0])
    assert c.stats()["rows"] == 2


def test_stream_batch_that_comes_again(spark, tmp_path):
    """Also after a failure behind the commit: the number stands in the commit's own marker, and a snapshot keeps it."""
    c = Collection.create(spark, f"{tmp_path}/s", 4)
    rows = spark.createDataFrame([(0, "add", 1, 1, 1, [1.0, 0.0, 0.0, 0.0])], changelog.SCHEMA)
    assert c.commit_table(rows, stream=0).mutations == 1
    assert Collection.open(spark, c.path).commit_table(rows, stream=0).mutations == 0
    c.flush()
    again = Collection.open(spark, c.path)
    assert again.commit_table(rows, stream=0).mutations == 0 and again.stats()["rows"] == 1
    rows.write.parquet(f"{tmp_path}/in/1")
    other = Collection.create(spark, f"{tmp_path}/t", 4)
    changelog.follow(spark, f"{tmp_path}/in/1", other, f"{tmp_path}/check").awaitTermination()
    assert other.stats()["live_rows"] == 1


def test_arrivals(spark):
    at = lambda m: datetime.datetime(2026, 1, 1, 0, m)
    got = changelog.arrivals(spark.createDataFrame([(at(1), "add"), (at(4), "add"), (at(6), "delete")], "at timestamp, op string")).collect()
    assert sorted((r.start.minute, r.op, r.n) for r in got) == [(0, "add", 2), (5, "delete", 1)]


def test_struct_of_header():
    assert struct.calcsize("<8sQQQQQQ") == 56
