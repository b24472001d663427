"""Stages of the pipeline keep rows and columns of any name."""

import pytest

from paddock.llm import decontam, linededup, mixing, neardup, quality

PROSE = " ".join(f"word{k} and some other text of line {k}" for k in range(12))
STAGES = {
    "keep_good": lambda d, b: quality.keep_good(d), "drop_lines": lambda d, b: linededup.drop_lines(d), "keep_one": lambda d, b: neardup.keep_one(d), "remove_hits": lambda d, b: decontam.remove_hits(d, b),
    "mix": lambda d, b: mixing.mix_sources(d, with_documents=True),
}
NAMES = ["a.b", "x`y", "n_words", "kept", "Hit", "size", "removed", "kept_id", "n_chars"]


@pytest.mark.parametrize("stage", sorted(STAGES))
def test_columns_of_any_name(spark, stage):
    quoted = ", ".join(f"`{n.replace('`', '``')}` long" for n in NAMES)
    rows = [(1, PROSE, "s", *range(9)), (2, PROSE, "s", *range(9)), (3, PROSE.replace("word", "term"), None, *range(9)), (None, None, "t", *[None] * 9), (4, "", "t", *range(9))]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {quoted}")
    bench = spark.createDataFrame([("i", "nothing of that kind is in any of these documents at all")], "item_id string, text string")
    made = STAGES[stage](docs, bench)
    assert made.columns[: len(docs.columns)] == docs.columns
    got = made.collect()
    assert got and all(tuple(r)[3:11] == (tuple(range(8)) if r.doc_id else (None,) * 8) for r in got)
    assert STAGES[stage](docs.limit(0), bench).count() == 0
