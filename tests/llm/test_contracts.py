"""Every registered query of the operators, over tables with odd rows, against brute force; and clashing column names."""

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import neardup, quality, registry, sharding, tokens, toxicity, wordscan
from tests.llm.conftest import ODD
from tests.llm.test_text import brute_components, figures

SPACES = [(20, "x\nx"), (21, " "), (22, "a\nb\na"), (23, "\n\n"), (24, ""), (25, "q\r\nq\r\nq")]
ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly box up forty large jugs of old grape juice"
TURNS = [(1, 0, "user", "hi ### there"), (1, 1, "assistant", "a </turn> b ␛h"), (1, 2, "user", None), (1, 3, "assistant", "ok\n### x"), (2, None, "assistant", "z"), (2, 0, None, "y"), (3, 0, "user", "only"), (None, 0, "assistant", "n")]
PAGE = "<html><body><nav>menu</nav><article><p>First  part &amp; more of it, long enough to count as text.</p><p>Second part of the article, long enough as well.</p></article><footer>end</footer></body></html>"


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    rows = [(i, t, "en", "s", 0) for i, t in [*ODD, *SPACES, (30, f"Before it. {ITEM}. After it.")]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(3, 0, 0), (4, 1, 0), (8, 0, 1), (20, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a.b/c", PAGE), (2, "http://a.b/d", PAGE), (3, None, None)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return str(d)


@pytest.fixture(scope="module")
def docs_of(spark, place):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{place}/documents.parquet").collect()]


def rows(spark, place, name):
    return registry.QUERIES[name](spark, place).collect()


def crc(text):
    return zlib.crc32((text or "").encode())


def test_op1(spark, place, docs_of):
    got = rows(spark, place, "op1_quality")
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((i, *figures(t)) for i, t in docs_of)


def test_op1_texts_without_words_beside_others(spark):
    """No line runs on into the next text, whatever the order."""
    for texts in (["x\nx", " "], [" ", "x\nx"], ["", "x\nx", "\n", "x\nx\n", " \n"], ["x\nx", "", " x"]):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        got = {r.doc_id: r.n_dup_lines for r in quality.score(df, None).collect()}
        assert got == {i: figures(t)[3] for i, t in enumerate(texts)}


def test_op1_character_trigrams():
    block = next(wordscan.blocks(pa.array(["aé漢", "", "x😀yz", "é"])))
    c, at = quality.characters(block)
    assert at.tolist() == [0, 3, 3, 7, 8]
    assert [int(x).to_bytes(4, "little").rstrip(b"\0").decode() for x in c] == list("aé漢x😀yzé")


def rendezvous(key, shards):
    """The greatest of the hashes of key and shard, by the library's XXH64; seeds chain as in Spark."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    own = xxhash.xxh64_intdigest(b"rendezvous", 42)
    own = xxhash.xxh64_intdigest(struct.pack("<q", key), own) if key is not None else own
    scores = [signed(xxhash.xxh64_intdigest(struct.pack("<i", s), xxhash.xxh64_intdigest(struct.pack("<Q", own), 42))) for s in range(shards)]
    return scores.index(max(scores))


def test_op2(spark, place, docs_of):
    got = rows(spark, place, "op2_sharding")
    want = Counter((i, len((t or "").encode()) + 16, crc(t), "key", rendezvous(i, 40), rendezvous(i, 41)) for i, t in docs_of)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 5, 6, 7, 8), (1, "a b c", 5, 6, 7, 9), (2, "d", 5, 6, 7, 8)], "doc_id long, text string, base int, _gone int, salt int, _salt int")
    got = sharding.assign(df)
    assert set(got.columns) == {*df.columns, "shard", "slot"} and got.select(df.columns).exceptAll(df).isEmpty() and got.count() == 3
    kept = neardup.keep(df)
    assert kept.columns == df.columns and kept.count() == 3


def test_op3(spark, place):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in rows(spark, place, "op3_html_text")}
    text = "First part & more of it, long enough to count as text.\nSecond part of the article, long enough as well."
    assert got == {1: ("http://a.b/c", text, len(text)), 2: ("http://a.b/d", text, len(text)), 3: (None, "", 0)}


def test_op4(spark, place, docs_of):
    got = rows(spark, place, "op4_toxicity")
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in docs_of)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_op4_sparse_pool_is_the_dense_convolution():
    rng = np.random.default_rng(1)
    rows_, embed = np.arange(50, dtype=np.int32), rng.normal(size=(51, toxicity.DIM))
    embed[-1] = 0
    n = toxicity.FILTERS * len(toxicity.WIDTHS)
    kernels = [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS]
    model = toxicity.Model(rows_, embed, kernels, rng.normal(size=n), rng.normal(size=n), 0.1)
    for _ in range(20):
        at = np.concatenate([[0], np.cumsum(rng.integers(0, 12, 6))])
        index = np.where(rng.random((3, at[-1])) < 0.6, 50, rng.integers(0, 50, (3, at[-1])))
        top, where = model.pool(index, at)
        for d in range(6):
            e = embed[index[:, at[d] : at[d + 1]]].sum(0)
            for j, w in enumerate(toxicity.WIDTHS):
                for f in range(toxicity.FILTERS):
                    c = j * toxicity.FILTERS + f
                    places = [(e[s : s + w] * kernels[j][:, :, f]).sum() + model.bias[c] for s in range(len(e) - w + 1)]
                    assert np.isclose(top[d, c], max([model.bias[c], *places]))
                    if where[d, c] >= 0:
                        assert np.isclose(places[where[d, c] - at[d]], top[d, c])


def test_op5(spark, place, docs_of):
    library = Tokenizer.from_file(tokens.default_path())
    got = rows(spark, place, "op5_token_counts")
    n = {t: len(library.encode(t or "", add_special_tokens=False).ids) for _, t in docs_of}
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == Counter((i, len((t or "").encode()), n[t], n[t] > 2048) for i, t in docs_of)


def test_op6(spark, place):
    got = {r.conv_id: r for r in rows(spark, place, "op6_chat")}
    own = registry.CONTROL_TEXT
    every = {}
    for c, turn, role, text in [*TURNS, (-7, 0, "user", own), (-7, 1, "assistant", own)]:
        every.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(every)
    for c, turns in every.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        all_turns = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(all_turns.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_op7(spark, place, docs_of):
    got = rows(spark, place, "op7_near_duplicates")
    want = brute_components([(i, t) for i, t in docs_of], 2)
    assert len(got) == len(docs_of)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_op7_large_buckets_are_dealt_anew(spark, monkeypatch):
    """One text with an edit in each copy, some edits far apart: many components in buckets of hundreds of rows."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(80)]
    texts = [(i, " ".join("new%d" % rng.integers(1 << 30) if rng.random() < p else w for w in base)) for i, p in enumerate(rng.choice([0.02, 0.06, 0.1], 400).tolist())]
    want = {i: c for i, (_, c) in brute_components(texts, 2).items()}
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for large, block, part in ((4096, 512, 2048), (5, 3, 7), (4096, 3, 7)):
        monkeypatch.setattr(neardup, "LARGE", large)
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(neardup, "SLICE", part)
        assert {r.doc_id: r.component_id for r in neardup.groups(df).collect()} == want


def test_op8(spark, place):
    got = rows(spark, place, "op8_decontamination")
    assert [(r.doc_id, r.item_id, r.coverage) for r in got] == [(30, 1, 1.0)]


def test_op9_and_op10(spark, place, docs_of):
    library = Tokenizer.from_file(tokens.default_path())
    ids = lambda t, end: np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4")
    got = rows(spark, place, "op9_packing")
    want = Counter()
    for i, t in docs_of:
        own = ids(t, 0)
        for k, s in enumerate(range(0, len(own), 2048)):
            want[i, k, s, len(own[s : s + 2048]), zlib.crc32(own[s : s + 2048].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    total = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == total[r.sequence_id]
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 2048 and len(total) == -(-sum(total.values()) // 2048)
    got = sorted(rows(spark, place, "op10_token_files"), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(ids(t, 1)), zlib.crc32(ids(t, 1).tobytes())) for i, t in docs_of)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(i for i, _ in docs_of if i is not None)


def test_pipeline_on_odd_rows(spark, place):
    import corpus_pipeline

    d, n = spark.read.parquet(f"{place}/documents.parquet"), None
    columns = d.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, place)
        assert d.columns == columns and (n is None or d.count() <= n)
        n = d.count()
    assert d.where(F.col("doc_id") == 30).isEmpty()
    empty = spark.read.parquet(f"{place}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, place).count() == 0
