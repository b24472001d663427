"""Benchmark decontamination with an FM-index per shard of the training texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, any_names, flat, marked, runs, shared, text_slices, unused, written

IS_WORD = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SAMPLE = 16
MADE = ("n_words", "n_hit", "items", "spans")
SHARD = 1 << 20  # bytes of the texts of one index


class FMIndex:
    """FM-index of a sequence of symbols: wavelet-matrix ranks over its transform, every SAMPLE-th position kept."""

    def __init__(self, seq: np.ndarray, sigma: int):
        seq = np.concatenate([seq, [0]]).astype(np.int64)  # symbol 0 ends the text; no other place has it
        n = self.n = len(seq)
        order = suffix_order(seq)
        last = seq[order - 1]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.kept = np.where(order % SAMPLE == 0, order, -1)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.zeros, self.ranks, self.bits = [], [], []
        for level in reversed(range(self.levels)):
            bit = (last >> level) & 1
            self.bits.append(bit.astype(bool))
            self.ranks.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            last = np.concatenate([last[bit == 0], last[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place of the transform."""
        low = np.zeros(len(symbol), np.int64)
        for k, level in enumerate(reversed(range(self.levels))):
            one = (symbol >> level) & 1 == 1
            up_low, up_at = self.ranks[k][low], self.ranks[k][at]
            low = np.where(one, self.zeros[k] + up_low, low - up_low)
            at = np.where(one, self.zeros[k] + up_at, at - up_at)
        return at - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            one, up = self.bits[k][at], self.ranks[k][at]
            out = out * 2 + one
            at = np.where(one, self.zeros[k] + up, at - up)
        return out

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of every pattern (right-aligned in its line) by backward search."""
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n)
        width = patterns.shape[1]
        for step in range(width):
            live = np.flatnonzero((sizes > step) & (low < high))
            if not len(live):
                break
            c = patterns[live, width - 1 - step].astype(np.int64)
            low[live], high[live] = self.starts[c] + self.rank(c, low[live]), self.starts[c] + self.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: walk back through the transform to a kept position."""
        rows, out, walked = rows.copy(), np.zeros(len(rows), np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            kept = self.kept[rows[open_]]
            found = kept >= 0
            out[open_[found]] = kept[found] + walked
            open_ = open_[~found]
            c = self.symbol(rows[open_])
            rows[open_] = self.starts[c] + self.rank(c, rows[open_])
            walked += 1
        return out


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes that are still tied are sorted again. The last symbol is the least."""
    n = len(seq)
    rank = seq.astype(np.int64) + 1
    rank[-1] = 0
    order = np.argsort(rank, kind="stable")
    head = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    place = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = place
    width = 1
    while True:
        size = np.diff(np.concatenate([np.flatnonzero(head), [n]]))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            return order
        who = order[tied]
        key = rank[who] * (n + 1) + np.where(who + width < n, rank[np.minimum(who + width, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[tied], key = who[by], key[by]
        head[tied] = np.concatenate([[True], key[1:] != key[:-1]])
        place = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[order[tied]] = place[tied]
        width *= 2


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of lower-cased texts."""
    starts, ends = runs(IS_WORD[data], offsets)
    return starts, ends, RangeHash(LOWERED[data])(starts, ends)


def phrases(texts: pa.Array, names: list, window: int) -> dict:
    """Distinct windows of the items as word symbols, with the items of each (their places in `names` from `cuts`)."""
    data, offsets = flat(texts)
    starts, _, hashes = word_spans(data, offsets)
    known = np.unique(hashes)
    symbols = np.searchsorted(known, hashes) + 2
    cuts = np.searchsorted(starts, offsets)
    n = np.diff(cuts)
    times = np.where(n >= window, n - window + 1, np.minimum(n, 1))
    of = np.repeat(np.arange(len(n)), times)
    begin = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + cuts[of]
    sizes = np.minimum(n[of], window)
    lines = np.zeros((len(of), window), np.int32)
    for k in range(window):  # right-aligned
        there = sizes > k
        lines[there, window - 1 - k] = symbols[(begin + sizes - 1 - k)[there]]
    lines, which = np.unique(lines, axis=0, return_inverse=True) if len(lines) else (lines, of)
    order = np.argsort(which, kind="stable")
    return {
        "known": known, "lines": lines, "sizes": (lines > 0).sum(axis=1), "names": ["" if x is None else str(x) for x in names],
        "of": of[order], "cuts": np.searchsorted(which[order], np.arange(len(lines) + 1)),
    }


def hit_batches(block, first: bool, last: bool):
    """Adds what a block of phrases hits: word ranges and items; each slice of texts is a shard with its own index.

    The first pass starts the two columns, the last turns them into counts and byte ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, limit=SHARD):
            data, offsets = flat(part.column("text"))
            starts, ends, hashes = word_spans(data, offsets)
            cuts = np.searchsorted(starts, offsets)
            hit, items = np.zeros(len(starts) + 1, np.int32), [set() for _ in range(part.num_rows)]
            if not first:
                for k, (ranges, names) in enumerate(zip(part.column("hit").to_pylist(), part.column("items").to_pylist(), strict=True)):
                    items[k].update(names)
                    for a, b in ranges:
                        hit[cuts[k] + a] += 1
                        hit[cuts[k] + b] -= 1
            if len(block.value["sizes"]) and len(starts):
                search_shard(block.value, hashes, cuts, hit, items)
            covered = np.cumsum(hit)[:-1] > 0
            a, b = runs(covered, cuts)
            doc, spans = np.searchsorted(cuts, a, "right") - 1, [[] for _ in items]
            for x, y, k in zip(a.tolist(), b.tolist(), doc.tolist(), strict=True):
                spans[k].append([int(starts[x] - offsets[k]), int(ends[y - 1] - offsets[k])] if last else [x - int(cuts[k]), y - int(cuts[k])])
            kept = [c for c in part.schema.names if c not in ("text", "hit", "items")]
            made = [pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int64())))]
            names = ["items", "spans" if last else "hit"]
            if last:
                counts = [np.diff(cuts), marked(covered, cuts)]
                made, names = [pa.array(x.astype(np.int64)) for x in counts] + made, ["n_words", "n_hit", *names]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *made, part.column("text")], [*kept, *names, "text"])

    return run


def search_shard(block: dict, hashes: np.ndarray, cuts: np.ndarray, hit: np.ndarray, items: list[set]) -> None:
    """Mark the words of all occurrences of a block's phrases.

    Words outside the phrases are one separator, and stretches shorter than the shortest phrase can't
    hold one; neither needs a place in the index.
    """
    known = block["known"]
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    symbols = np.where(known[at] == hashes, at + 2, 1)
    a, b = runs(symbols > 1, cuts)
    long = b - a >= block["sizes"].min()
    a, b = a[long], b[long]
    if not len(a):
        return
    size = b - a + 1  # a separator after each stretch
    where = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
    seq = symbols[np.minimum(where, len(symbols) - 1)]
    seq[np.cumsum(size) - 1] = 1
    index = FMIndex(seq, len(known) + 2)
    low, high = index.search(block["lines"], block["sizes"])
    found = np.flatnonzero(high > low)
    times = (high - low)[found]
    if not len(found):
        return
    rows = np.repeat(low[found] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    begin = where[index.locate(rows)]
    phrase = np.repeat(found, times)
    np.add.at(hit, begin, 1)
    np.add.at(hit, begin + block["sizes"][phrase], -1)
    doc = np.searchsorted(cuts, begin, "right") - 1
    for d, p in np.unique(np.stack([doc, phrase], axis=1), axis=0).tolist():
        items[d].update(block["names"][k] for k in block["of"][block["cuts"][p] : block["cuts"][p + 1]].tolist())


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, list[int]]:
    """(table of item_id, text, block; the blocks): items dealt by hash, so that no block of several items is over `block_bytes`.

    An item of more than half a block has a block of its own, so it adds one and doesn't change how the others are dealt.
    """
    asked = benchmark.select("item_id", "text").where("text is not null").distinct()
    asked = asked.select("*", F.octet_length("text").cast("long").alias("bytes"), F.xxhash64("item_id", "text").alias("h"))
    long = F.col("bytes") * 2 > block_bytes
    count = max(1, -(-(asked.agg(F.sum(F.when(~long, F.col("bytes")))).first()[0] or 0) // block_bytes))
    while True:
        dealt = asked.withColumn("block", F.when(long, F.least(F.col("h"), -1 - F.col("h"))).otherwise(F.pmod("h", F.lit(count))))  # below 0 for long ones
        found = dealt.groupBy("block").agg(F.sum("bytes").alias("bytes"))
        if found.where((F.col("bytes") > block_bytes) & (F.col("block") >= 0)).isEmpty():
            return written(dealt.select("item_id", "text", "block"), "benchmark"), [r[0] for r in found.select("block").orderBy("block").collect()]
        count *= 2


@any_names
def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """All columns of `docs` but clashing ones, with n_words, n_hit, items, spans (byte ranges) for every row.

    The benchmark is a stated query set. Spark deals it into blocks of `block_bytes` at most (or one
    longer item), and the driver holds and broadcasts the phrases of one block at a time; every block is
    searched in every shard, and what it hits is written before the next. NULL or wordless texts have no
    words and no hits; items without words are skipped, a NULL item_id counts as the empty string, and
    repeated items are one. Phrases never cross documents. Empty tables give empty results or no hits.
    A text longer than a shard is a shard of its own.
    """
    spark = docs.sparkSession
    table, blocks = benchmark_blocks(benchmark, block_bytes)
    found = docs.select(*[c for c in docs.columns if c.lower() not in (*MADE, "hit", "text")], F.col("text").alias("text"))
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in found.schema if f.name != "text")
    kinds = f"{kinds}, " if kinds else ""
    for k, block in enumerate(blocks or [None]):
        items = table.where(F.col("block") == F.lit(block)).toArrow()
        phrase = shared(spark, phrases(items.column("text").combine_chunks(), items.column("item_id").to_pylist(), window))
        last = k >= len(blocks) - 1
        made = "n_words bigint, n_hit bigint, items array<string>, spans array<array<bigint>>" if last else "items array<string>, hit array<array<bigint>>"
        found = found.mapInArrow(hit_batches(phrase, k == 0, last), f"{kinds}{made}, text string")
        if not last:
            found = written(found, "hits")
            phrase.unpersist()
    return found


def verdicts(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs.select("doc_id", "text"), benchmark, window)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        out = []
        for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
            if spans:
                raw, at, kept = text.encode(), 0, []
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                text = b"".join([*kept, raw[at:]]).decode()
            out.append(text)
        yield part.set_column(part.schema.get_field_index("text"), pa.field("text", pa.string()), pa.array(out, pa.string()))


@any_names
def remove_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """`docs` with hit words, and what stands between them, cut out of the texts; n_chars follows where it exists.

    Every row is cut by its own text, so rows may repeat a doc_id; NULL and empty texts stay as they are;
    an empty table stays empty; columns of any other name, in any case, stay.
    """
    spare = {c: unused(f"own_{c}", docs.columns) for c in docs.columns if c.lower() in (*MADE, "hit")}
    found = contamination(docs.withColumnsRenamed(spare), benchmark, window)
    cut = found.mapInArrow(cut_batches, found.schema)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.drop(*MADE).withColumnsRenamed({v: c for c, v in spare.items()}).select(docs.columns)


def sha_of_items(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
