"""Every assistant turn is an example with its whole context, and the digest counts what the examples hold: op6."""

from pyspark.sql import functions as F

from lodestar.llm import chat


def test_examples(spark):
    turns = [(c, k, "assistant" if (k + c) % 3 == 1 else "user", f"turn {k} of {c} ### </turn>\n" * (k % 4)) for c in range(4) for k in range(3 + 5 * c)]
    turns += [(9, 0, "user", "no example"), (None, 0, "assistant", "alone")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    written = {(r.conv_id, r.position): r.written for r in chat.transcripts(df).collect()}
    want, chars = {}, {}
    for c in {t[0] for t in turns}:
        own = [t for t in turns if t[0] == c]
        targets = [k for k, t in enumerate(own) if t[2] == "assistant"]
        for k in targets:
            want[c, k] = ("".join(written[c, j] for j in range(k)), written[c, k])
        rest = sum(len(written[c, j]) for j in range(max(targets, default=-1) + 1, len(own)))
        chars[c] = sum(len(want[c, k][0] + want[c, k][1]) for k in targets) + rest
    rows = chat.examples(df).collect()
    assert len(rows) == len(want) and {(r.conv_id, r.position): (r.context, r.reply) for r in rows} == want
    assert all(r.context_chars == len(r.context) for r in rows)
    assert {r.conv_id: r.formatted_chars for r in chat.digest(chat.transcripts(df)).collect()} == chars
    assert chat.examples(df.where(F.lit(False))).isEmpty()
