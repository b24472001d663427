"""A long benchmark item adds one block, whatever the others are, and the blocks change no result."""

from paddock.llm import decontam

WORDS = [f"w{k}x{k * 7 % 13}" for k in range(6000)]


def test_a_long_item_adds_one_block(spark):
    short = [(f"s{k}", " ".join(WORDS[11 * k : 11 * k + 40])) for k in range(300)]
    long = ("long", " ".join(WORDS[4000:5000]))
    blocks = lambda rows: len(decontam.benchmark_blocks(spark.createDataFrame(rows, "item_id string, text string"), 4000)[1])
    assert len(long[1]) > 4000
    without = blocks(short)
    assert 10 < without < 200 and blocks([*short, long]) == without + 1 and blocks([*short, long, ("other", long[1])]) == without + 2
    docs = spark.createDataFrame([(1, "some words " + " ".join(WORDS[4500:4530])), (2, " ".join(WORDS[100:150])), (3, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([*short[:20], long], "item_id string, text string")
    got = [{(r.doc_id, r.n_hit, tuple(r["items"])) for r in decontam.contamination(docs, bench, block_bytes=b).collect()} for b in (1 << 22, 2000)]
    assert got[0] == got[1] and {r[1] > 0 for r in got[0] if r[0] < 3} == {True}
