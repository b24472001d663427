"""Spelling variants: words at one edit from each other, found by a variable-length gram index.

Grams start at every place of a word (with a mark at both ends) and are as short as the gram dictionary allows: a gram
that is frequent over all words is replaced by its extensions, a rare one is not extended. What a gram is depends on
its own characters only, so one edit affects the grams that hold the edited place, and no others: those before it keep
their distance from the left end of the word, those after it from the right end.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, shared, text_slices, written

LETTERS = "A-Za-zÀ-ÿ"
LEFT, RIGHT = "^", "$"  # marks of the two ends; no letters
SHORTEST, LONGEST = 3, 5  # of grams
SLOTS = 1 << 20  # of the sketch of list lengths
FLUSH = 100_000  # different words that a task holds before it hands their counts on


def counted(batches: Iterator[pa.RecordBatch], least: int, drop_one_in: int) -> Iterator[pa.RecordBatch]:
    """Counts of the words of texts, summed over as many texts as FLUSH allows."""
    pattern, total = re.compile(f"[{LETTERS}]{{{least},}}"), Counter()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return made

    for batch in text_slices(batches):
        data, offsets = flat(batch.column("text"))
        edges = offsets.tolist()
        for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), edges[:-1], edges[1:], strict=True):
            for word, n in Counter(m[0] for m in pattern.finditer(data[a:b].tobytes().lower().decode())).items():
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
                if drop_one_in and h % drop_one_in == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                if len(word) >= least:
                    total[word] += n
            if len(total) >= FLUSH:
                yield out()
    yield out()


def word_counts(docs: DataFrame, least: int = 7, occurrences: int = 2, drop_one_in: int = 31) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, of `least` code points and `occurrences` in all texts at least."""
    kept = docs.select("doc_id", "text").mapInArrow(lambda batches: counted(batches, least, drop_one_in), "word string, n long")
    return kept.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def gram_dictionary(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, entries: int = 1 << 14) -> dict[str, int]:
    """The frequent grams and their counts: those over a share 1 / `entries` of all places in words.

    There can be no more than `entries` of each length, whatever the number of words.
    """
    marked = F.concat(F.lit(LEFT), F.col("word"), F.lit(RIGHT))
    places = words.agg(F.sum(F.length("word") + 2)).first()[0] or 0
    at = lambda k: F.transform(F.sequence(F.lit(1), F.length("w") - (k - 1)), lambda i: F.substr("w", i, F.lit(k)))
    grams = words.select(marked.alias("w")).select(F.explode(F.flatten(F.array(*[at(k) for k in range(2, longest + 1)]))).alias("gram"))
    frequent = grams.groupBy("gram").count().where(F.col("count") > places // entries)
    return dict(frequent.toArrow().to_pandas().itertuples(index=False, name=None))


def grams(marked: str, frequent: dict[str, int], shortest: int = SHORTEST, longest: int = LONGEST) -> list[str]:
    """The gram at each place of a marked word: extended as long as it is frequent, short enough and inside the word."""
    out, n = [], len(marked)
    for a in range(n - 1):
        k = shortest
        while k < longest and a + k < n and marked[a : a + k] in frequent:
            k += 1
        out.append(marked[a : a + k])
    return out


def affected(spans: list[tuple[int, int]], n: int) -> int:
    """The most of the spans [start, end) of a word of n characters that one edit changes.

    An edit changes a character or puts one between two others; the latter changes spans on both sides of a place only
    if they hold both neighbours, and so never more than a change of one of them.
    """
    return max(sum(a <= i < b for a, b in spans) for i in range(n))


def keys_of(found: list[str], n: int, m: int) -> tuple[list[str], list[str]]:
    """The lists of a word's grams among words of m characters: by the distance from the left end, and from the right end."""
    return [f"L{a}:{m}:{g}" for a, g in enumerate(found)], [f"R{n - a}:{m}:{g}" for a, g in enumerate(found)]


def probes(found: list[str], left: list[int], right: list[int]) -> tuple[int, int]:
    """The places of the two grams whose lists are merged: of all pairs that no edit affects together, the one with the shortest lists.

    Of two such grams one edit leaves one: the number of grams less the most that are affected is the least number of
    lists on which a near word must be, here 2 - 1.
    """
    best, first, k = None, 0, 0
    ends = sorted((a + len(g), a) for a, g in enumerate(found))
    for b in range(len(found)):
        while k < len(ends) and ends[k][0] <= b:  # of the grams that end before place b the one with the shortest list
            first = ends[k][1] if k == 0 or left[ends[k][1]] < left[first] else first
            k += 1
        if k and (best is None or left[first] + right[b] < best[0]):
            best = (left[first] + right[b], first, b)
    assert affected([(a, a + len(found[a])) for a in best[1:]], len(found) + 1) == 1
    return best[1:]


def parity(word: str) -> int:
    """A bit for each letter (modulo 63), set if the word has it an odd number of times; one edit changes two bits at most."""
    out = 0
    for c in word:
        out ^= 1 << ord(c) % 63
    return out


def payload(batch: pa.RecordBatch, rows: list[int]) -> list[pa.Array]:
    take, odd = pa.array(rows, pa.int64()), pa.array([parity(w) for w in batch.column("word").to_pylist()], pa.int64())
    return [batch.column("word").take(take), batch.column("n").take(take), odd.take(take)]


def indexed(batches: Iterator[pa.RecordBatch], frequent, longest: int) -> Iterator[pa.RecordBatch]:
    """A row for every gram of a word and either end."""
    for batch in batches:
        keys, rows = [], []
        for row, word in enumerate(batch.column("word").to_pylist()):
            found, n = grams(LEFT + word + RIGHT, frequent.value, longest=longest), len(word) + 2
            for each in keys_of(found, n, n):
                keys += each
            rows += [row] * (2 * len(found))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *payload(batch, rows)], ["key", "word", "n", "parity"])


def probing(batches: Iterator[pa.RecordBatch], frequent, lengths, longest: int) -> Iterator[pa.RecordBatch]:
    """The two lists of a word to merge, among words as long and among those one longer."""
    for batch in batches:
        keys, rows, firsts, places = [], [], [], []
        for row, word in enumerate(batch.column("word").to_pylist()):
            found, n = grams(LEFT + word + RIGHT, frequent.value, longest=longest), len(word) + 2
            for m in (n, n + 1):
                left, right = keys_of(found, n, m)
                a, b = probes(found, *[[lengths.value[zlib.crc32(k.encode()) % SLOTS] for k in side] for side in (left, right)])
                keys += [left[a], right[b]]
                firsts += [None, found[a]]
                places += [None, a]
                rows += [row, row]
        columns = [pa.array(keys, pa.string()), *payload(batch, rows), pa.array(firsts, pa.string()), pa.array(places, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "word", "n", "parity", "first", "place"])


def list_lengths(index: DataFrame) -> list[int]:
    """How many rows of the index have a key, summed over the keys of a slot: SLOTS numbers, whatever the number of words."""
    found = index.groupBy(F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(SLOTS)).alias("slot")).count().toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("count").to_numpy()
    return out.tolist()


def near_pairs(words: DataFrame, entries: int = 1 << 14, longest: int = LONGEST) -> DataFrame:
    """(word, n, other, other_n): each unordered pair of different words at one inserted, deleted or replaced code point, once.

    words(word, n) have `longest` code points at least, so that every word has two grams that no edit affects together.
    """
    spark, words = words.sparkSession, words.select("word", "n")
    frequent = shared(spark, gram_dictionary(words, longest=longest, entries=entries))
    index = words.mapInArrow(lambda b: indexed(b, frequent, longest), "key string, word string, n long, parity long")
    lengths = shared(spark, list_lengths(index))
    probe = words.mapInArrow(lambda b: probing(b, frequent, lengths, longest), "key string, word string, n long, parity long, first string, place int")
    s, t = probe.alias("s"), index.alias("t")
    # words of equal length find each other; a pair on both lists counts on the left one
    once = (F.length("t.word") > F.length("s.word")) | (F.col("s.word") < F.col("t.word"))
    fresh = F.expr(f"s.first is null or substring(concat('{LEFT}', t.word, '{RIGHT}'), s.place + 1, length(s.first)) <> s.first")
    met = s.join(t, (F.col("s.key") == F.col("t.key")) & once & (F.bit_count(F.col("s.parity").bitwiseXOR(F.col("t.parity"))) <= 2) & (F.levenshtein("s.word", "t.word", 1) == 1) & fresh)
    return met.select("s.word", "s.n", F.col("t.word").alias("other"), F.col("t.n").alias("other_n"))


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form) -> (word, root): forms followed to the last, by jumps of doubling length. Words without form don't appear."""
    jumps = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = jumps.join(ahead, "root", "left")
        jumps = written(longer.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if jumps.where("moved").isEmpty():
            return jumps.drop("moved")
        jumps = jumps.drop("moved")


def spelling_variants(docs: DataFrame, least: int = 7, occurrences: int = 2, ratio: int = 10, drop_one_in: int = 31) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the texts.

    A word's form is its near word of largest n (ties: the smallest), if that is `ratio` times the word's n at least;
    its root is the last of its forms. `drop_one_in` plants misspellings (0: none): where it divides the crc32 of
    `doc_id:word`, that code point of the word is left out. NULL and empty texts have no words, a NULL doc_id counts as
    an empty one, repeated rows count again, an empty table gives an empty result, other columns are ignored. A long
    text is read run by run; a task holds FLUSH different words and those of one text.
    """
    words = written(word_counts(docs, least, occurrences, drop_one_in), "words")
    pairs = written(near_pairs(words, longest=min(LONGEST, least)), "near")
    both = pairs.select("word", "n", "other", "other_n").unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    known = words.join(best, "word", "left").withColumn("fits", F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False)))
    known = written(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), F.col("best.other")).alias("form"), F.when(F.col("fits"), -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
