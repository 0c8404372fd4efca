"""Sharding, token counts, packing and token files against plain Python and the tokenizers library."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import packing, sharding, token_counts, token_files, tokens

PATH = tokens.default_path()
LIBRARY = tokens.library(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


@pytest.fixture(scope="module", params=["odd", "docs"])
def table(request):
    df = request.getfixturevalue(request.param)
    return df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_counts(table):
    df, rows = table
    got = Counter(map(tuple, token_counts.count_tokens(df, PATH).collect()))
    assert got == Counter((i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 2048) for i, t in rows)


def test_files(spark, table):
    df, rows = table
    got = token_files.round_trip(df, PATH).select("key", "start", "n_tokens", F.crc32("ids")).collect()
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((i, len(ids(t)) + 1, crc([*ids(t), 1])) for i, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r[1]):
        assert r[1] == at
        at += r[2]
    order = [(-1 if r[0] is None else r[0]) for r in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order)


def test_packing(table):
    df, rows = table
    got = packing.pack(df, PATH).collect()
    whole = defaultdict(list)
    for r in got:
        whole[r.sequence_id].append((r.offset, r.length))
        assert r.start == 2048 * r.piece and 0 < r.length <= 2048
    for places in whole.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048
    want = Counter()
    for i, t in rows:
        x = [*ids(t), 0]
        want.update((i, s // 2048, s, len(x[s : s + 2048]), crc(x[s : s + 2048])) for s in range(0, len(x), 2048))
    assert Counter(tuple(r)[:5] for r in got) == want
    total = sum(len(ids(t)) + 1 for _, t in rows)
    assert len(whole) <= -(-total // 2048) + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 30), min_size=1, max_size=40))
def test_plan_is_best_fit(counts):
    groups = packing.plan(counts, 100)
    used = Counter()
    for n, items in groups:
        assert sum(x * k for x, k in items) <= 100
        for x, k in items:
            used[x] += n * k
    assert used == Counter(counts)
    rooms = []
    for x in sorted(Counter(counts).elements(), reverse=True):
        fit = [r for r in rooms if r >= x]
        rooms.remove(min(fit)) if fit else None
        rooms.append((min(fit) if fit else 100) - x)
    assert sum(n for n, _ in groups) == len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=60))
def test_codes_round_trip(values):
    control, data = token_files.encode_ids(np.array(values, np.uint32))
    assert token_files.decode_ids(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(values)).tolist() == values


def test_damaged_block():
    block = token_files.pack_block([1, None], np.array([1, 2]), np.array([1, 1]), np.array([3, 4]))
    assert token_files.unpack_block(block)[0] == [1, None]
    with pytest.raises(ValueError, match="damaged"):
        token_files.unpack_block(block[:-6] + b"\0" + block[-5:])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"]), max_size=30), min_size=1, max_size=5))
def test_any_text(texts):
    import pyarrow as pa

    from lodestar.llm import wordscan

    for block in wordscan.blocks(pa.array(texts)):
        flat, at = tokens.encoder(PATH).ids(block)
        for k in range(len(at) - 1):
            assert flat[at[k] : at[k + 1]].tolist() == ids(texts[block.first + k])


def test_empty_tables(odd):
    none = odd.where("false")
    assert token_counts.count_tokens(none, PATH).count() == packing.pack(none, PATH).count() == token_files.round_trip(none, PATH).count() == sharding.assign(none).count() == 0


def test_shards(odd, docs):
    for df in (odd, docs):
        got = sharding.assign(df).withColumn("grown", sharding.rendezvous(F.col("doc_id"), 41)).collect()
        assert len(got) == df.count()
        for s in {r.shard for r in got}:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        assert all(r.grown in (r.shard, 40) for r in got)
    assert {r.text for r in sharding.assign(odd).collect()} == {r.text for r in odd.collect()}


def test_weights(spark):
    n = spark.range(20_000).groupBy(sharding.rendezvous(F.col("id"), 3, [1.0, 2.0, 1.0]).alias("s")).count().orderBy("s").collect()
    assert [round(r["count"] / 20_000, 1) for r in n] == [0.2, 0.5, 0.2] or abs(n[1]["count"] - 10_000) < 400
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), 2, [1.0, 0.0])
