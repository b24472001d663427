"""Hashes of byte ranges: strings with structure don't meet, and nothing is lost or miscounted by them."""

import numpy as np
import pytest

from paddock.llm import common, decontam, linededup, quality, suffixdedup
from paddock.llm.common import RangeHash

SIZES = (1024, 2048, 65_536)


def complements(n: int) -> tuple[str, str]:
    """The Thue-Morse string of n letters and the one with the letters exchanged."""
    bits = np.zeros(1, np.uint8)
    while len(bits) < n:
        bits = np.concatenate([bits, 1 - bits])
    return (97 + bits[:n]).tobytes().decode(), (98 - bits[:n]).tobytes().decode()


@pytest.mark.parametrize("block", [7, 64, 1 << 17])
def test_equal_strings_and_only_they_have_equal_hashes(block, monkeypatch):
    monkeypatch.setattr(common, "BLOCK", block)
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 2000).astype(np.uint8)
    starts = rng.integers(0, 2000, 10_000)
    ends = np.minimum(2000, starts + rng.integers(0, 70, 10_000))
    seen = {}
    for a, b, h in zip(starts, ends, RangeHash(data)(starts, ends), strict=True):
        assert seen.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen) > 3000


@pytest.mark.parametrize("n", SIZES)
@pytest.mark.parametrize("seed", [1, 2, 20240229])
def test_complementary_strings_differ(n, seed):
    one, two = complements(n)
    data = np.frombuffer((one + two).encode(), np.uint8)
    found = RangeHash(data, seed)(np.array([0, n]), np.array([n, 2 * n]))
    assert found[0] != found[1]
    both = suffixdedup.range_digests(data, np.array([0, n, 0]), np.array([n, 2 * n, n])).to_pylist()
    assert both[0] == both[2] != both[1]


def test_complementary_lines_and_words_in_the_operators(spark):
    docs, items, k = [], [], 0
    for n in SIZES:
        one, two = complements(n)
        docs += [(k, f"{one}\n{two}"), (k + 1, one), (k + 2, two)]
        items.append((str(n), one))
        k += 3
    table = spark.createDataFrame(docs, "doc_id long, text string")
    counts = {r.doc_id: r.n_dup_lines for r in quality.text_counts(table).collect()}
    assert set(counts.values()) == {0}
    bench = spark.createDataFrame(items, "item_id string, text string")
    hit = {r.doc_id: (r.n_hit, r.n_items) for r in decontam.verdicts(table, bench).collect()}
    assert hit == {i: (0, 0) if i % 3 == 2 else (1, 1) for i in range(k)}
    # the two strings have the same shingles, so as near lines they are one; as equal lines they aren't
    left = {r.doc_id: r.text for r in linededup.drop_lines(table.where("doc_id % 3 > 0"), similar=1.01).collect()}
    assert left == {i: t for i, t in docs if i % 3}
