"""Line links: pairs are left out by sketch only where no exact comparison can link them; contraction stops where it is done."""

import random

from paddock.llm import components as c
from paddock.llm import linededup as d


def test_sketches_leave_out_no_similar_pair():
    dice = random.Random(5)
    stems = ["".join(dice.choices("abcdefg é日", k=dice.choice([9, 60, 200]))) for _ in range(12)]
    some = []
    for _ in range(200):
        line = list(dice.choice(stems))
        for _ in range(dice.choice([0, 1, 2, 4])):
            line[dice.randrange(len(line))] = dice.choice("xyz")
        some.append("".join(line).encode())
    some += [b"", b"short", b"abcdefgh", ("日" * 9).encode(), b"ab" * 70_000, b"ab" * 70_001]
    drawn, far = list(d.sketches(some)), 0
    for i in range(len(some)):
        for j in range(i):
            left = d.too_far(drawn[i], drawn[j], d.SIMILAR)
            far += left
            assert not (left and d.similar_lines(some[i], some[j], d.shingles, d.SIMILAR))
    assert far > len(some) ** 2 / 3


def test_stars_need_no_round(spark):
    edges = lambda *rows: spark.createDataFrame(rows, "a long, b long")
    assert c.stars(edges((5, 1), (6, 1), (9, 2)))
    assert not c.stars(edges((5, 1), (6, 5)))  # a chain
    assert not c.stars(edges((5, 1), (5, 2)))  # two ways down
    got = {tuple(r) for r in c.components(edges((1, 5), (6, 5), (7, 6), (9, 2), (3, 3))).collect()}
    assert got == {(1, 1), (5, 1), (6, 1), (7, 1), (2, 2), (9, 2)}
