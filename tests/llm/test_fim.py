"""Fill-in-the-middle against a plain cut, and the index of boundaries against the boundaries."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paddock.llm import fim

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by slicing the list of tokens."""
    tokens = TOKEN.findall(text or "")
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text or ""
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    return (len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fim_against_plain_cut(spark):
    odd = [None, "", "x", "<P", "a<S", "<", "a <P> b", "<M><S>", "é", "日本 語\n\n", "ab1cd", "\U0001f600 smile", "  ", "word " * 3000, "x" * 5000 + "9" * 5000, "é" * 4000 + "y", "M>M><S", "q" * 300_000 + " tail " * 30_000]
    rows = [(k, odd[k % len(odd)], f"t{k}", 7) for k in range(8 * len(odd))] + [(None, "no id at all", "t", 7), (5, "again", "t", 7), (5, "again", "t", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, `n.x` long").repartition(3)
    made = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted((r.doc_id is None, r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.collect())
    want = sorted((i is None, i, *plain(i, t), t or "") for i, t, _, _ in rows)
    assert got == want
    assert fim.digests(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 400) | st.just(100_000), max_size=300), max_size=5), st.integers(1, 127))
def test_rank_index_is_exact(portions, error):
    index, offsets, at = fim.RankIndex(error), [], 0
    for steps in portions:
        rising = at + np.cumsum(np.array(steps, np.int64)) if steps else np.zeros(0, np.int64)
        index.append(rising)
        offsets += rising.tolist()
        at = offsets[-1] if offsets else 0
    index.done()
    assert index[np.arange(len(offsets))].tolist() == offsets
    assert np.abs(index.residuals.astype(int)).max(initial=0) <= error


def test_rank_index_needs_few_segments():
    words = np.random.default_rng(3).integers(1, 9, 200_000)
    index = fim.RankIndex()
    index.append(np.cumsum(words))
    assert len(index.done().firsts) < 1000
