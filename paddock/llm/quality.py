"""Quality rules by weak supervision: votes, expectation-maximisation, posterior probability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, any_in, any_names, counts_between, flat, marked, mix, runs, text_slices, unused, written

IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
IS_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
IS_ALPHA = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
IS_UPPER = np.isin(np.arange(256), list(range(65, 91)))
IS_DIGIT = np.isin(np.arange(256), list(range(48, 58)))
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words", "n_upper", "n_letters", "n_digits", "n_ended_lines"]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more, is a later occurrence) for each key."""
    order = np.argsort(keys, kind="stable")
    same = np.concatenate([[False], keys[order][1:] == keys[order][:-1]]) if len(keys) else np.zeros(0, bool)
    later, many = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = same
    many[order] = same | np.concatenate([same[1:], [False]]) if len(keys) else same
    return many, later


def counts_of(column: pa.Array) -> list[np.ndarray]:
    """The COUNTS of each text. Of a long text only masks of a byte a byte and arrays by word are held."""
    data, offsets = flat(column)
    hashed = RangeHash(data)
    inside = ~IS_SPACE[data]
    starts, ends = runs(inside, offsets)
    heads = (data & 0xC0) != 0x80
    chars, letters = marked(inside & heads, offsets), marked(IS_ALPHA[data] & heads, offsets)
    alpha = any_in(IS_ALPHA[data], starts, ends)
    del inside, heads
    # 8-word windows that are found again in the same text
    cuts = np.searchsorted(starts, offsets)
    word = hashed(starts, ends)
    n = max(0, len(word) - WINDOW + 1)
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        key = key * np.uint64(0x2545F4914F6CDD1D) + word[k : k + n]
    of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    whole = np.flatnonzero(of[:n] == of[WINDOW - 1 :]) if n else np.zeros(0, np.int64)
    again = whole[repeated(mix(key[whole] + of[whole].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))[0]]
    cover = np.zeros(len(word) + 1, np.int32)
    cover[again] += 1  # places within `again` differ
    cover[again + WINDOW] -= 1
    covered = np.cumsum(cover)[:-1] > 0
    del key, of, word
    # lines with a word
    line_starts, line_ends = runs(data != 10, offsets)
    line_words = np.searchsorted(starts, line_ends) - np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[line_words > 0], line_ends[line_words > 0]
    line_of = np.searchsorted(offsets, line_starts, "right") - 1
    _, later = repeated(mix(hashed(line_starts, line_ends) + line_of.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
    last = ends[np.searchsorted(ends, line_ends, "right") - 1] - 1 if len(line_ends) else line_ends
    ended = np.isin(data[last], list(b".!?:;\"')")) if len(last) else np.zeros(0, bool)
    return [
        np.diff(cuts), chars, marked(IS_SYMBOL[data], offsets), np.bincount(line_of[later], minlength=len(column)),
        counts_between(starts[covered], offsets), counts_between(line_starts, offsets), counts_between(starts[alpha], offsets),
        marked(IS_UPPER[data], offsets), letters, marked(IS_DIGIT[data], offsets), counts_between(line_starts[ended], offsets),
    ]


def count_batches(names: list[str], drop: tuple[str, ...] = ()):
    """The rows with the COUNTS of their texts under the given names, without the columns in `drop`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            kept = [c for c in part.schema.names if c not in drop]
            counts = [pa.array(x.astype(np.int64)) for x in counts_of(part.column("text"))]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *counts], [*kept, *names])

    return run


def text_counts(docs: DataFrame, names: list[str] = COUNTS, drop: tuple[str, ...] = ("text",)) -> DataFrame:
    """`docs` without `drop`, with counts of every whole text, from its bytes."""
    kept = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in drop)
    return docs.mapInArrow(count_batches(names, drop), ", ".join([kept, *[f"`{c}` bigint" for c in names]]))


def band(value: Column, good: Column, bad: Column) -> Column:
    """A vote: 1 for good, -1 for bad, 0 to abstain."""
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules(named: dict[str, str] | None = None) -> dict[str, Column]:
    """The rules and when they vote. A ratio over nothing is NULL, and then the rule abstains. `named`: other names of the counts."""
    c = lambda x: F.col((named or {}).get(x, x))
    per = lambda a, b: F.try_divide(c(a), c(b))
    ratio = lambda x, good, bad: band(x, x <= good, x > bad)
    length, alpha, ended = per("word_chars", "n_words"), per("n_alpha_words", "n_words"), per("n_ended_lines", "n_lines")
    return {
        "word_count": band(c("n_words"), c("n_words") >= 50, c("n_words") < 20),
        "word_length": band(length, (length >= 3) & (length <= 10), (length < 2.5) | (length > 14)),
        "symbols": ratio(per("n_symbols", "n_words"), 0.1, 0.3),
        "duplicate_lines": ratio(per("n_dup_lines", "n_lines"), 0.1, 0.3),
        "repeated_words": ratio(per("n_repeat_words", "n_words"), 0.1, 0.3),
        "letters": band(alpha, alpha >= 0.85, alpha < 0.7),
        "capitals": ratio(per("n_upper", "n_letters"), 0.2, 0.5),
        "digits": ratio(per("n_digits", "word_chars"), 0.1, 0.3),
        "line_ends": band(ended, ended >= 0.7, ended < 0.2),
    }


def fit_accuracies(patterns: dict[str, int], rounds: int = 50) -> tuple[np.ndarray, float]:
    """(accuracy of each rule when it votes, share of good texts) by expectation-maximisation.

    Works on counts of vote patterns, of which there are 3 to the number of rules at most, whatever the
    number of texts. Accuracies stay within [0.55, 0.99], so that the classes can't swap.
    """
    votes = np.array([[int(x) - 1 for x in p] for p in patterns], float)
    weight = np.array(list(patterns.values()), float)
    accuracy, prior = np.full(votes.shape[1], 0.8), 0.8
    for _ in range(rounds):
        good = posterior(votes, accuracy, prior)
        right = (weight[:, None] * ((votes == 1) * good[:, None] + (votes == -1) * (1 - good)[:, None])).sum(0)
        accuracy = np.clip((right + 8) / ((weight[:, None] * (votes != 0)).sum(0) + 10), 0.55, 0.99)
        prior = float(np.clip((weight * good).sum() / weight.sum(), 0.5, 0.98))
    return accuracy, prior


def posterior(votes: np.ndarray, accuracy: np.ndarray, prior: float) -> np.ndarray:
    return 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + votes @ np.log(accuracy / (1 - accuracy)))))


def judged(counted: DataFrame, names: list[str], threshold: float) -> DataFrame:
    """`counted` with base_failed, votes, quality and kept under the names given after those of the COUNTS."""
    failed_, votes_, quality_, kept_ = names[len(COUNTS) :]
    as_named = dict(zip(COUNTS, names, strict=False))
    votes = F.concat(*[(F.coalesce(v, F.lit(0)) + 1).cast("string") for v in rules(as_named).values()])
    counted = written(counted.withColumn(votes_, votes), "votes")
    patterns = {r[0]: r[1] for r in counted.groupBy(votes_).count().collect()}  # 3 ** len(rules()) rows at most
    known = []
    if patterns:
        accuracy, prior = fit_accuracies(patterns)
        quality = posterior(np.array([[int(x) - 1 for x in p] for p in patterns], float), accuracy, prior)
        known = [(p, float(q)) for p, q in zip(patterns, quality, strict=True)]
    known = counted.sparkSession.createDataFrame(known, f"`{votes_}` string, `{quality_}` double")
    n_words, n_repeat = F.col(as_named["n_words"]), F.col(as_named["n_repeat_words"])
    found = counted.join(F.broadcast(known), votes_).withColumn(failed_, (n_words < 20) | (100 * n_repeat > 30 * n_words))
    return found.withColumn(kept_, ~F.col(failed_) & (F.col(quality_) >= threshold))


def quality_verdicts(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A row for every row of `docs`: doc_id, counts, base_failed, votes, quality, kept.

    Votes of all texts are counted by pattern, the rules' accuracies follow by expectation-maximisation,
    and `quality` is the posterior probability of a good text; kept where it reaches `threshold` and the
    base rules (20 words at least, no more than 30 % of words in repeated 8-word windows) hold. NULL and
    empty texts have no words and fail the base. Rows that repeat a doc_id are judged each. An empty
    table gives an empty result. Other columns are ignored. A text of any length is taken whole; it
    needs some ten times its size in memory.
    """
    names = [*COUNTS, "base_failed", "votes", "quality", "kept"]
    return judged(text_counts(docs.select("doc_id", "text")), names, threshold).select("doc_id", *names)


@any_names
def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that are kept, each judged by its own text, with all their columns.

    NULL and empty texts fail the base and go; rows that repeat a doc_id are judged each; an empty table
    stays empty; columns of any name stay as they are. The rows pass the rules once and are written with
    their votes, so nothing is shuffled or joined but the votes' probabilities.
    """
    names = []
    for name in (*COUNTS, "base_failed", "votes", "quality", "kept"):
        names.append(unused(name, [*docs.columns, *names]))
    return judged(text_counts(docs, names[: len(COUNTS)], ()), names, threshold).where(F.col(names[-1])).select(docs.columns)
