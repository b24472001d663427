"""Spans of the rules against `re`, in chunks of any length, and in time in proportion to the matches."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from paddock.llm import secrets


def plain(text, rule):
    return [(m.start(), m.end()) for m in re.finditer(rule.regex, text) if len(m[rule.group or 0]) >= rule.least]


def texts(seed):
    draw = random.Random(seed)
    parts = ["password: 'abcdef1'", "token=ab", "AKIA" + "A1" * 10, "AKIA1", "0a" * 13, "\u00e9\U0001f600", "ghp_" + "a1B2" * 9, "sk_live_" + "x9" * 12, "-----BEGIN RSA PRIVATE KEY-----", "xoxb-123456789012-abcdefghij", "eyJhbGciOiJI.eyJzdWIiOiIx.abc_-123", "AIza" + "b" * 35, "\n", " ", "deadbeef" * 4]
    return ["".join(draw.choice(parts) + draw.choice(["", " ", "\n"]) for _ in range(n)) for n in (0, 1, 2, 3, 7, 40, 300)] + [""]


@pytest.mark.parametrize("chunk", [1, 2, 512])
def test_spans_of_every_rule(spark, chunk):
    rows = spark.createDataFrame(list(enumerate(texts(chunk))), "doc_id long, text string")
    for rule in secrets.RULES:
        got = {r.doc_id: [(x.start, x.end) for x in r.spans] for r in rows.select("doc_id", secrets.found_spans(F.col("text"), rule, chunk).alias("spans")).collect()}
        assert got == {i: plain(t, rule) for i, t in enumerate(texts(chunk))}, rule


def test_many_matches_in_one_text(spark):
    """A megabyte of hexadecimal runs: 40,000 matches; a fold over all of them would copy 800 million spans."""
    one = "0a1b2c3d4e5f60718293a4b5 " * 40_000
    began = time.time()
    got = secrets.secret_report(spark.createDataFrame([(1, one)], "doc_id long, text string")).select("doc_id", "n_hex").collect()
    assert [tuple(r) for r in got] == [(1, 40_000)]
    assert time.time() - began < 60
