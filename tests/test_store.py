"""The collection's rules, its files, and equality of all ways to search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import generators, vectors as V
from lodestar.operators import ivf, search
from lodestar.operators.predicate import Filter, checked_range, from_document
from lodestar.sources import portable
from lodestar.sources.collection import Collection, CollectionError
from lodestar.streaming import changelog

LOW, HIGH = -(2**63), 2**63 - 1


@pytest.fixture
def three(spark):
    c = Collection.new(spark, 2)
    c.add_batch([(30, 7, LOW, [1, 0]), (10, 7, 0, [0, 2]), (20, 8, HIGH, [1, 1])])
    yield c
    c.close()


def ids(df):
    return [r.id for r in df.collect()]


def test_filters_and_slots(three):
    assert ids(three.filter()) == [30, 10, 20]
    assert ids(three.filter(Filter(7))) == [30, 10]
    assert ids(three.filter(Filter(None, LOW, HIGH))) == [30, 10]
    assert ids(three.filter(Filter(7, 0, None))) == [10]
    assert ids(three.filter(Filter(None, 5, 5))) == []
    with pytest.raises(ValueError, match="InvalidFilterRange"):
        checked_range(2, 1)
    assert from_document({"$and": [{"user_id": 7}, {"timestamp": {"$gte": 0}}]}) == Filter(7, 0)


def test_batches_are_ordered_and_atomic(three):
    before = three.generation
    for batch, error in (([("add", 1, 1, 1, [1, 0]), ("add", 30, 1, 1, [1, 0])], "DuplicateId"), ([("delete", 99, None, None, None)], "UnknownId"), ([("add", 5, 1, 1, [0, 0])], "ZeroNormVector"), ([("add", 5, 1, 1, [1])], "DimensionMismatch"), ([("add", 5, 1, 1, [float("nan"), 1])], "NonFiniteVector")):
        with pytest.raises(CollectionError, match=error):
            three.commit(batch)
    assert three.generation == before and three.stats()["rows"] == 3
    three.commit([("add", 40, 1, 1, [1, 0]), ("delete", 40, None, None, None)])
    assert three.generation == before + 2 and three.stats()["tombstones"] == 1
    with pytest.raises(CollectionError, match="AlreadyDeleted"):
        three.delete(40)
    with pytest.raises(CollectionError, match="DuplicateId"):
        three.add(40, 1, 1, [1, 0])
    assert three.get_record(40).live is False


def test_search_rules(three):
    hits, report = three.search([1, 0], k=2)
    assert ids(hits) == [30, 20] and report.predicate == "All"
    assert three.search_batch([]) [1] == []
    for k in (0, 65):
        with pytest.raises(ValueError, match="InvalidK"):
            three.search([1, 0], k=k)
    with pytest.raises(ValueError, match="ZeroNormVector"):
        three.search([0, 0], Filter(12345))
    rows, total = three.scan_records(0, 2, None)
    assert ids(rows) == [30, 10] and total == 3


def test_closed(three):
    three.close()
    three.close()
    assert ids(three.filter()) == [] and three.get_record(30) is None and three.scan_records()[1] == 0
    with pytest.raises(CollectionError, match="Closed"):
        three.search([1, 0])


def test_reopen_flush_and_portable(spark, tmp_path):
    path = (tmp_path / "c").as_uri()
    c = Collection.create(spark, path, 2)
    c.add_batch([(1, 1, 1, [3, 4]), (2, 1, 2, [1, 0])])
    c.delete(2)
    again = Collection.open(spark, path)
    assert again.generation == 3 and [round(x, 6) for x in again.get_record(1).vector] == [0.6, 0.8]
    again.flush()
    again.add(3, 2, 3, [0, 1])
    again.flush()
    assert Collection.open(spark, path).stats() == again.stats()
    with pytest.raises(CollectionError, match="AlreadyExists"):
        Collection.create(spark, path, 2)
    target = str(tmp_path / "x.bin")
    again.export_portable(target)
    with pytest.raises(FileExistsError):
        again.export_portable(target)
    back = Collection.import_portable(spark, target)
    order = ["slot", "id", "user_id", "timestamp", "vector", "live"]
    assert back.records().select(order).orderBy("slot").collect() == again.records().select(order).orderBy("slot").collect()
    assert back.generation == again.generation
    raw = bytearray(open(target, "rb").read())
    for change, what in ((lambda b: b[:-9], "length"), (lambda b: b[:50] + bytes([b[50] ^ 1]) + b[51:], "checksum"), (lambda b: b[:8] + b"\2" + b[9:], "version")):
        bad = tmp_path / f"{what}.bin"
        bad.write_bytes(change(bytes(raw)))
        with pytest.raises(portable.Damaged, match=what):
            portable.read(str(bad))


def test_gap_in_the_logs(spark, tmp_path):
    c = Collection.create(spark, (tmp_path / "g").as_uri(), 2)
    for i in range(3):
        c.add(i, 0, 0, [1, i])
    c.files.drop("commits/00000000000000000002-log.json")
    with pytest.raises(CollectionError, match="Corrupt"):
        Collection.open(spark, c.path)


def near_ties(spark, n, d):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(8, d))
    rows = [(i * 13 + 7, i % 3, i, i % 7 != 0, i, (base[i % 8] + (0 if i % 4 else 1e-5) * rng.normal(size=d)).astype(np.float32).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, user_id long, timestamp long, live boolean, slot long, raw array<float>").withColumn("vector", V.normalized(F.col("raw")))


def test_all_strategies_agree(spark):
    r = near_ties(spark, 600, 17).cache()
    for where in (Filter(), Filter(1), Filter(None, 100, 300)):
        for k in (1, 10, 64):
            q = r.where("slot = 5").first().raw
            want = search.top_k(r, q, k, where, search.REFERENCE).collect()
            for s in (search.BLOCK, search.INT8):
                assert search.top_k(r, q, k, where, s).collect() == want
    queries = r.where("slot < 5").select(F.col("slot").alias("query_id"), F.col("raw").alias("query"))
    got = search.batch_top_k(r, queries, 10)
    assert [x.id for x in got.where("query_id = 3").orderBy("rank").collect()] == [x.id for x in search.top_k(r, r.where("slot = 3").first().raw, 10).collect()]


def test_ties_go_by_id(spark):
    rows = [(100 - i, 0, 0, i != 0, i, [1.0, 0.0, 0.0]) for i in range(100)]
    r = spark.createDataFrame(rows, "id long, user_id long, timestamp long, live boolean, slot long, vector array<float>")
    for s in (search.REFERENCE, search.BLOCK):
        assert ids(search.top_k(r, [1, 0, 0], 64, strategy=s)) == list(range(1, 65))


def test_ivf_recall_and_rules(spark):
    v = generators.vectors(spark, 2048, 16, 7, 8).withColumn("vector", V.normalized(F.col("vector")))
    r = v.select("id", F.lit(0).cast("long").alias("user_id"), "id", F.lit(True).alias("live"), F.col("id").alias("slot"), "vector").toDF("id", "user_id", "timestamp", "live", "slot", "vector").cache()
    q = r.where("id % 128 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    index = ivf.build(r, 8)
    want = {(x.query_id, x.id) for x in search.batch_top_k(r, q, 10).collect()}
    for codes in (False, True):
        got = {(x.query_id, x.id) for x in ivf.search(index, r, q, 10, 4, codes=codes).collect()}
        assert len(want & got) / len(want) >= 0.9
    with pytest.raises(ValueError, match="InvalidIvfConfig"):
        ivf.check(9, 8)
    assert ivf.tune({1: 0.8, 2: 0.95, 4: 0.99}, 0.95) == 2


def test_generators():
    x = generators.splitmix64(np.arange(2), 0)
    assert [int(v) for v in x] == [16294208416658607535, 7960286522194355700]
    assert sorted(generators.shuffled(50, 3)) == list(range(50))


def test_stream_of_mutations(spark, tmp_path):
    c = Collection.new(spark, 2)
    rows = [(i, "add", i, 0, i, [1.0, float(i)]) for i in range(4)] + [(4, "delete", 2, None, None, None)]
    spark.createDataFrame(rows, changelog.SCHEMA).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        changelog.follow(spark, str(tmp_path / "in"), c, str(tmp_path / "cp")).awaitTermination()
    assert ids(c.filter()) == [0, 1, 3] and c.generation == 5
    c.close()
