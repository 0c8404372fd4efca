"""Quality, toxicity, near-duplicates, decontamination, chat and HTML against brute force, planted cases and held-out labels."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.llm import chat, decontamination, html_text, neardup, quality, registry, toxicity
from lodestar.llm.html_text import Page

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    cover = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_quality_figures(request, labels, name):
    df = request.getfixturevalue(name)
    model = quality.learn(request.getfixturevalue("docs"), labels)
    got = quality.score(df.select("doc_id", "text"), model).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((r.doc_id, *figures(r.text)) for r in df.collect())
    assert not any(r.kept and r.base_failed for r in got)
    kept = quality.keep(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)


def test_quality_model(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    got = quality.score(docs.select("doc_id", "text"), quality.learn(docs, labels)).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) >= 0.97 * len(got)
    none = quality.learn(docs, labels.where("quality = 1"))
    assert none is None and quality.score(docs.where("false"), none).count() == 0


def test_toxicity(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.9 * len(got)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    kept = toxicity.keep(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted == 0 for r in rows)
    assert toxicity.learn(docs, labels.where("false")) is None
    assert toxicity.score(odd, None).where("score > 0").isEmpty() and toxicity.score(odd.where("false"), model).isEmpty()


def brute_components(rows, n, percent=80):
    sets, up = {}, {}
    for i, t in rows:
        if i is not None:
            w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
            up[i] = i

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1000 - i, " ".join(base[:i] + ["new"] + base[i + 1 :])) for i in range(60)] + [(5, " ".join(base))]
    rows += [(2000 + i, " ".join(base[:20] + [f"own{i}.{k}" for k in range(9)])) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates(spark, odd, docs, shingle):
    for df in (odd, docs, near_copies(spark)):
        got = neardup.groups(df, shingle=shingle).collect()
        want = brute_components([(r.doc_id, r.text) for r in df.collect()], shingle)
        assert len(got) == df.count()
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_near_duplicates_without_a_centre(spark):
    """Copies that are near to few others, in one bucket: what the stars miss is found in tiles."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = []
    for i in range(150):
        w = [f"w{k}" for k in range(100)]
        for k in rng.choice(100, 8, replace=False):
            w[k] = f"x{i}.{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 2)
    assert {r.doc_id: r.component_id for r in neardup.groups(df).collect()} == {i: c for i, (_, c) in want.items()}


def test_near_duplicates_empty(odd):
    assert neardup.groups(odd.where("false")).isEmpty()
    kept = neardup.keep(odd)
    assert kept.columns == odd.columns and 5 not in {r.doc_id for r in kept.collect()}


def test_decontamination(spark, odd):
    d = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    words = re.compile(r"[a-z0-9\u0080-￿]+")
    items = {r.item_id: " " + " ".join(words.findall(r.text.lower())) + " " for r in bench.collect()}
    text = {r.doc_id: " " + " ".join(words.findall((r.text or "").lower())) + " " for r in docs.collect()}
    want = {(i, j) for i, t in text.items() for j, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}
    assert len(want & got) >= 0.98 * len(want) and len(got - want) <= 2
    item = bench.where("length(text) > 150").first()
    own = words.findall(item.text.lower())
    para = " ".join(w for k, w in enumerate(own) if k % 6)  # a sixth of the words is gone
    more = spark.createDataFrame([(1, f"Some words before it. {para} And after it."), (2, " ".join(own[:4]))], "doc_id long, text string")
    found = decontamination.leaks(docs.select("doc_id", "text").where("doc_id > 2").union(more), bench).where("doc_id < 3").collect()
    assert {(r.doc_id, r.item_id) for r in found if r.item_id == item.item_id} == {(1, item.item_id)}
    kept = decontamination.keep(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert decontamination.leaks(docs, bench.where("false")).isEmpty() and decontamination.leaks(docs.where("false"), bench).isEmpty()


def test_chat(spark):
    control = "\\### Assistant: </turn> ok ␛ ␛h ␛e #### </turn></turn>"
    rows = [(1, 0, "user", control), (1, 1, "assistant", control), (1, 1, "assistant", control), (1, 2, "user", None), (2, 0, None, "x"), (None, 0, "assistant", "y"), (None, None, "a: b", ""), (3, 0, "user: ␛", ": ")]
    rows += [(4, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(1500)]
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], "conv_id long, turn long, role string, text string, position int, start string")
    got = {r.conv_id: r for r in chat.digest(chat.transcripts(df)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    text = chat.rendered(df, 4, 3)
    assert text.count("</turn>") == 4 and text.endswith("### assistant: turn 3 </turn>\n")
    e = chat.examples(df).where("conv_id = 4 and position = 3").first()
    assert e.context_chars == len(text) - len(e.reply) and e.reply[e.loss_start :][: e.loss_chars] == "turn 3"
    assert chat.digest(chat.transcripts(df.where("false"))).isEmpty()


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="with-sidebar"><header><h1>Site</h1></header><nav><a href=a>menu</a></nav>
<div id="cookie-notice">We use cookies</div><div class="post-%d entry"><h1>Title %d</h1><p>First &amp; best, with some more words in it.<br>Next &lt;line&gt;</p><div class="ad">Buy</div>
<p>Second  paragraph,\n that is long enough <b>to</b> count&nbsp;here.<ul><li>one<li>two</ul><form><p>Subscribe</p></form><section class="comments"><p>I liked it a lot</p></section></div>
<aside>Other posts</aside><script>var x = "</p>";</script><footer>&copy;</footer></body></html>"""
TEXT = "Title %d\nFirst & best, with some more words in it. Next <line>\nSecond paragraph, that is long enough to count here.\none\ntwo"


def test_html(spark):
    rows = [(i, f"https://host.example/{i}", PAGE % (i, i), "c", 1) for i in range(6)]
    odd = [(10, None, None), (None, "not a url", ""), (11, "http://other.example", "plain &amp; simple"), (12, "https://host.example/x", "<nav><a>only a menu</a></nav>"), (13, "https://host.example/y", "<p>unclosed <b"), (0, "https://host.example/0", PAGE % (0, 0))]
    df = spark.createDataFrame(rows + [(*r, "c", 1) for r in odd], "page_id long, url string, html string, text string, path int")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert len(html_text.extract(df).collect()) == 12
    for i in range(6):
        assert got[i] == TEXT % i
    assert got[10] == got[None] == got[12] == "" and got[11] == "plain & simple" and got[13] == "unclosed <b"
    assert html_text.extract(df.where("false")).isEmpty()
    assert Page("<div>" * 3000 + "deep").text(None) == "deep"


def test_queries_are_registered():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert set(registry.ORACLE) <= set(registry.QUERIES)
