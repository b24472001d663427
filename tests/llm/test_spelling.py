"""Spelling variants against all pairs, on words that share much of each other."""

import random
import re
import zlib
from collections import Counter

from paddock.llm import spelling


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def brute(rows, drop=31):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if drop and h % drop == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    around = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in around.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, n[w], len(around[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n}


def texts(seed, docs=150):
    draw = random.Random(seed)
    parts = ["the", "on", "tion", "ing", "er", "en", "\u00e9re", "\u00d7", "a", "aa", "Th", "ON"]
    stems = ["".join(draw.choice(parts) for _ in range(draw.randint(2, 5))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "abababab", "babababa", "aaaaaaab", "thetion\u0130x"]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(60):
            w = draw.choice(stems[: 1 + int(len(stems) * draw.random() ** 3)])
            if draw.random() < 0.15 and w:
                at = draw.randrange(len(w))
                w = draw.choice([w[:at] + w[at + 1 :], w[:at] + draw.choice("aent\u00e9") + w[at:], w[:at] + draw.choice("aent") + w[at + 1 :]])
            words.append(w)
        rows.append((i, draw.choice([" ", "\n", "1"]).join(words)))
    return rows


def test_variants_against_all_pairs(spark):
    rows = [*texts(5), (None, "nowhere nowhere Nowhere"), (900, None), (901, ""), (902, "x" * 2000 + " " + "x" * 2000), (5, texts(5)[5][1])]
    rows += [(1000 + k, "correction " * 30 + "corection " + "corrrection corection") for k in range(4)]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, `n.n` long").repartition(4)
    got = {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_variants(docs).collect()}
    want = brute(rows)
    assert got == want and len(want) > 150 and any(r[3] for r in want)


def test_small_dictionary_gives_the_same_pairs(spark):
    """The dictionary and the sketch decide how long lists are, not what is found."""
    words = spelling.word_counts(spark.createDataFrame(texts(9), "doc_id long, text string")).cache()
    pairs = lambda **k: {(r.word, r.n, r.other, r.other_n) for r in spelling.near_pairs(words, **k).collect()}
    n = {r.word: r.n for r in words.collect()}
    want = {frozenset((a, b)) for a in n for b in n if near(a, b)}
    for options in ({}, {"entries": 1}, {"entries": 50, "longest": 7}, {"longest": 3}):
        got = pairs(**options)
        assert {frozenset((a, b)) for a, _, b, _ in got} == want and len(got) == len(want)
        assert all(n[a] == x and n[b] == y for a, x, b, y in got)


def test_roots_follow_chains(spark):
    chain = [(f"w{k:02}", f"w{k + 1:02}") for k in range(19)] + [("x", "w03")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert set(got.values()) == {"w19"} and len(got) == 20


def test_no_words(spark):
    assert spelling.spelling_variants(spark.createDataFrame([(1, "short ones")], "doc_id long, text string").limit(0)).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, "onlyoneword here")], "doc_id long, text string")).count() == 0
