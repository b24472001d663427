"""The pipeline's near-dedup stage against brute force on planted near copies."""

import random

import corpus_pipeline
import pytest

from paddock.llm import common, neardup, simhash

LOWER = str.maketrans(common.UPPER, common.LOWER)


def bag(text):
    w = (text or "").translate(LOWER).encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def planted():
    """Texts of 40 to 400 words and copies with one to several words changed, around Jaccard 0.8."""
    rng, rows = random.Random(11), []
    for k in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 400))]
        rows.append((10 * k, " ".join(base)))
        for c in range(1, 6):
            edited = list(base)
            for _ in range(max(1, len(base) * c // 225)):
                edited[rng.randrange(len(base))] = f"x{rng.randrange(10**6)}"
            rows.append((10 * k + c, " ".join(edited)))
    return rows


def brute_force(texts):
    ids, bags = sorted(texts), {k: bag(t) for k, t in texts.items()}
    sets = simhash.LocalSets(len(ids))
    for i in range(len(ids)):
        for j in range(i):
            a, b = bags[ids[i]], bags[ids[j]]
            if a == b or len(a & b) >= 0.8 * len(a | b) > 0:
                sets.join(i, j)
    return {d: ids[sets.root(i)] for i, d in enumerate(ids)}


@pytest.mark.parametrize("tile_rows", [neardup.TILE_ROWS, 7])
def test_planted_near_copies(spark, tile_rows):
    texts = dict(planted())
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)
    rows = neardup.near_components(df, tile_rows=tile_rows).collect()
    least = {}
    for r in rows:
        least[r.component] = min(least.get(r.component, r.doc_id), r.doc_id)
    want = brute_force(texts)
    assert len(set(want.values())) < len(want)
    assert {r.doc_id: least[r.component] for r in rows} == want


def test_stage_drops_near_copies(spark):
    texts = dict(planted())
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    assert {r.doc_id for r in stage(spark, df, None).collect()} == set(brute_force(texts).values())


def test_stage_on_given_documents(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in neardup.keep_one(docs).collect()} == set(brute_force(texts).values())


def test_repeated_ids_are_told_apart(spark):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    df = spark.createDataFrame([(1, a), (1, a), (2, b), (2, a), (None, b), (3, None), (4, "")], "doc_id long, text string")
    assert sorted((tuple(r) for r in neardup.keep_one(df).collect()), key=str) == [(1, a), (1, a), (2, b), (3, None)]
    assert neardup.keep_one(df.limit(0)).count() == 0
