"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, RangeHash, any_names, bloom, flat, may_hold, mix, partitions, text_slices, unused, written
from .components import components
from .decontam import LOWERED
from .quality import IS_SPACE

SHINGLE, BANDS, ROWS, SIMILAR, CHUNK = 8, 9, 4, 0.8, 1024
IS_INK = ~IS_SPACE
AHEAD = 4 * SHINGLE + 1  # bytes that hold the code points of one shingle and the next
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # of the first bytes of a machine word
STEP = 1 << 16
SKETCH = 1024  # bits
LONG = 100_000  # bytes from which a pair of lines is compared by arrays of hashes


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text, line number within its text) of all lines that hold a word."""
    breaks = np.flatnonzero(data == 10)
    edges = np.sort(np.concatenate([breaks + 1, offsets[:-1]]), kind="stable")  # where lines begin; empty ones at a text's end share a place
    edges = edges[edges < len(data)]
    if not len(edges):
        return (np.zeros(0, np.int64),) * 4
    some = np.logical_or.reduceat(IS_INK[data], edges) & (np.diff(edges, append=len(data)) > 0)
    starts, ends = edges[some], np.append(edges[1:], len(data))[some]
    ends = ends - (data[ends - 1] == 10)
    of = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, of, np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[of])


def longer_hash(words: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of strings of up to 32 bytes from the machine words at every byte."""
    out = mix((words[begin] & MASKS[np.minimum(sizes, 8)]) + sizes.astype(np.uint64))
    for k in (8, 16, 24):
        more = np.flatnonzero(sizes > k)
        out[more] = mix(out[more] + (words[begin[more] + k] & MASKS[np.minimum(sizes[more] - k, 8)]))
    return out


def shingle_blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(line, hash) of all shingles of SHINGLE code points of the lines [start, end), a block of bytes at a time.

    Shingles of ASCII are read as a machine word, those with longer characters as up to four.
    """
    for at in range(0, len(data), STEP):
        part = data[at : at + STEP + AHEAD]
        first, last = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + STEP)
        if first >= last:
            continue
        padded = np.concatenate([part, np.zeros(40, np.uint8)])
        words = np.ndarray(len(part) + 32, np.dtype("<u8"), padded, strides=(1,))
        wide = np.flatnonzero((part & 0xC0) == 0x80)
        low, high = np.maximum(starts[first:last] - at, 0), np.minimum(ends[first:last] - at, len(part))
        if len(wide):
            heads = np.flatnonzero((part & 0xC0) != 0x80)
            low, high, own = np.searchsorted(heads, low), np.searchsorted(heads, high), np.searchsorted(heads, STEP)
        else:
            own = min(STEP, len(part))
        sizes = np.maximum(np.minimum(high - SHINGLE + 1, own) - low, 0)
        where = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        begin = heads[where] if len(wide) else where
        hashed = mix(words[begin] & np.uint64((1 << 8 * SHINGLE) - 1))
        if len(wide):
            end = np.append(heads, len(part))[where + SHINGLE]
            longer = np.flatnonzero(end - begin > SHINGLE)
            if len(longer):
                hashed[longer] = longer_hash(words, begin[longer], (end - begin)[longer])
        yield np.repeat(np.arange(first, last), sizes), hashed


def signatures(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """One-permutation MinHash with BANDS * ROWS bins; empty bins borrow from the next filled one. A line without a shingle is one itself."""
    bins = BANDS * ROWS
    out = np.full((len(starts), bins), np.iinfo(np.uint64).max, np.uint64)

    def add(line: np.ndarray, grams: np.ndarray) -> None:
        place = line * bins + ((grams >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(out.reshape(-1), place, grams & np.uint64(0xFFFFFFFF))

    for line, grams in shingle_blocks(data, starts, ends):
        add(line, grams)
    empty = out == np.iinfo(np.uint64).max
    short = np.flatnonzero(empty.all(axis=1))
    add(short, whole[short])
    empty[short] = out[short] == np.iinfo(np.uint64).max
    todo = np.flatnonzero(empty.any(axis=1))
    full, filled = out[todo], ~empty[todo]
    have, source = filled.copy(), full.copy()
    for step in range(1, bins):
        if have.all():
            break
        use = ~have & np.roll(filled, -step, axis=1)
        full[use] = mix(np.roll(source, -step, axis=1)[use] + np.uint64(step * 0x100000001))
        have |= use
    out[todo] = full
    return out


def line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        raw, offsets = flat(part.column("text"))
        data = LOWERED[raw]
        starts, ends, of, number = line_spans(data, offsets)
        whole = RangeHash(data)(starts, ends)
        for at in range(0, len(starts), 20_000):  # a long text has many lines
            a, b, w = starts[at : at + 20_000], ends[at : at + 20_000], whole[at : at + 20_000]
            sig = signatures(data[a[0] : b[-1]], a - a[0], b - a[0], w).reshape(len(a), BANDS, ROWS)
            keys = np.zeros((len(a), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for k in range(ROWS):
                keys = mix(keys * np.uint64(0x2545F4914F6CDD1D) + sig[:, :, k])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view(np.int64)))
            where = pa.array(of[at : at + 20_000])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(where), part.column("tid").take(where), pa.array(number[at : at + 20_000]), pa.array(w.view(np.int64)), lists], ["doc_id", "tid", "line_no", "line", "bands"]
            )


def wanted_batches(words):
    """(line, body) of the lines that may be candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            raw, offsets = flat(part.column("text"))
            data = LOWERED[raw]
            starts, ends, _, _ = line_spans(data, offsets)
            line = RangeHash(data)(starts, ends).view(np.int64)
            _, first = np.unique(line, return_index=True)
            first = first[may_hold(words.value, line[first])]
            body = [data[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(line[first]), pa.array(body, pa.binary())], ["line", "body"])

    return run


def shared_batches(words):
    """(bucket, line) of the buckets that may hold several lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            bands = part.column("bands").flatten().to_numpy(zero_copy_only=False)
            line = np.repeat(part.column("line").to_numpy(zero_copy_only=False), BANDS)
            some = may_hold(words.value, bands)
            yield pa.RecordBatch.from_arrays([pa.array(bands[some]), pa.array(line[some])], ["bucket", "line"])

    return run


def shingles(body: bytes) -> set[str]:
    """The different shingles of a line; a shorter line is one itself."""
    text = body.decode()
    return {text[i : i + SHINGLE] for i in range(max(1, len(text) - SHINGLE + 1))}


def hashed_shingles(body: bytes) -> np.ndarray:
    """The same as sorted hashes."""
    data = np.frombuffer(body, np.uint8)
    return np.unique(np.concatenate([x for _, x in shingle_blocks(data, np.zeros(1, np.int64), np.array([len(data)]))]))


def sketches(bodies: list[bytes]) -> Iterator[tuple[int, int]]:
    """(number of shingles, a bit a shingle as one number) of each line; 0 shingles for lines under one or over LONG bytes."""
    begin = np.cumsum([0] + [len(b) for b in bodies])
    at = 0
    while at < len(bodies):
        to = max(at + 1, int(np.searchsorted(begin, begin[at] + SLICE_BYTES, "right")) - 1)
        some = [b if len(b) <= LONG else b"" for b in bodies[at:to]]
        ends = np.cumsum([len(b) for b in some])
        bits, sizes = np.zeros((len(some), SKETCH), bool), np.zeros(len(some), np.int64)
        for line, grams in shingle_blocks(np.frombuffer(b"".join(some), np.uint8), np.append(0, ends[:-1]), ends):
            bits[line, (grams >> np.uint64(20)) % np.uint64(SKETCH)] = True
            sizes += np.bincount(line, minlength=len(some))
        for n, row in zip(sizes.tolist(), np.packbits(bits, axis=1), strict=True):
            yield n, int.from_bytes(row.tobytes())
        at = to


def too_far(a: tuple[int, int], b: tuple[int, int], similar: float) -> bool:
    """Whether two sketches leave no room for a Jaccard of `similar`: a bit that one line has alone is a shingle that it has alone, at least."""
    (n, x), (m, y) = a, b
    if not n or not m:
        return False
    both = x & y
    mine, yours = (x ^ both).bit_count(), (y ^ both).bit_count()
    most = min(n - mine, m - yours)
    return most < similar * (most + mine + yours)


def similar_lines(a: bytes, b: bytes, bag, similar: float) -> bool:
    """Exact Jaccard of two lines; `bag` gives the shingles of the shorter kind."""
    if min(len(a), len(b)) > LONG:
        x, y = hashed_shingles(a), hashed_shingles(b)
        both = len(np.intersect1d(x, y, assume_unique=True))
    else:
        x, y = bag(a), bag(b)
        if min(len(x), len(y)) < similar * max(len(x), len(y)):
            return False
        both = len(x & y)
    return both >= similar * (len(x) + len(y) - both)


def verify_batches(similar: float):
    """Exact Jaccard within each bucket; a pair with one label, already connected here or sharing a lower bucket needs no comparison."""

    def links(bucket: int, rows: list[tuple]) -> Iterator[tuple[int, int]]:
        lines, chunks, labels, bodies, shared, drawn = zip(*rows, strict=True)
        bag = cache(shingles)
        lower = [{x for x in r if x < bucket} for r in shared]
        split = len(set(chunks)) > 1  # two chunks of a large bucket: pairs within one are compared elsewhere
        group, members = list(range(len(rows))), [[i] for i in range(len(rows))]
        by_label: dict[int, int] = {}
        for i, label in enumerate(labels):  # what is connected already is one group from the start
            if (first := by_label.setdefault(label, i)) != i:
                group[i] = first
                members[first].append(i)
                members[i] = []
        for i in range(len(rows)):
            mine = group[i]
            for j in range(i):
                if group[j] == mine or split and chunks[i] == chunks[j] or not lower[i].isdisjoint(lower[j]):
                    continue
                if not too_far(drawn[i], drawn[j], similar) and similar_lines(bodies[i], bodies[j], bag, similar):
                    small, mine = sorted((group[j], mine), key=lambda g: len(members[g]))
                    for k in members[small]:
                        group[k] = mine
                    members[mine] += members[small]
                    members[small] = []
        for some in members:  # a star a group, of one line for each label, as chains take more rounds to contract
            ends = sorted({labels[k]: lines[k] for k in some}.values())
            yield from ((ends[0], x) for x in ends[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def packed() -> pa.RecordBatch:
            found = list(links(key[0], held))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "sub", "line", "chunk", "label", "body", "shared")]
            for bucket, sub, *row in zip(*columns, sketches(columns[5]), strict=True):
                if (bucket, sub) != key:
                    if len(held) > 1:
                        yield packed()
                    key, held = (bucket, sub), []
                held.append(row)
        if len(held) > 1:
            yield packed()

    return run


def compared(rows: DataFrame, similar: float) -> DataFrame:
    """rows(bucket, sub, line, chunk, label, body, shared) -> links (a, b) within each (bucket, sub)."""
    dealt = rows.select("bucket", "sub", "line", "chunk", "label", "body", "shared").repartition(partitions(rows.sparkSession), "bucket", "sub")
    return dealt.sortWithinPartitions("bucket", "sub", "line").mapInArrow(verify_batches(similar), "a bigint, b bigint")


def similar_links(docs: DataFrame, occurrences: DataFrame, similar: float = SIMILAR, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between different lines that connect all with a Jaccard similarity of `similar` or more that share a band.

    A pair is compared in the lowest bucket that it shares; of buckets with the same members the lowest
    stays, so that one is always there. A bucket of more than `chunk` lines is cut into parts by hash.
    Pairs within a part come first, then one line of each group found so far; a bucket that is one group
    by then, as variants of a template are, is done after work in proportion to its lines. Only what is
    still apart is compared as pairs of parts, so that no link is lost and no task holds more than two.
    """
    banded = occurrences.groupBy("line").agg(F.first("bands").alias("bands")).select(F.explode("bands").alias("bucket"))
    shared = written(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    hits = occurrences.select("line", "bands").mapInArrow(shared_batches(bloom(shared.select("bucket"))), "bucket bigint, line bigint").distinct()
    rows = written(hits.join(shared, "bucket"), "rows")
    sized = rows.groupBy("bucket", "n").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.bit_xor(F.xxhash64("line")).alias("all"))
    buckets = sized.groupBy("n", "low", "high", "all").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    members = written(rows.drop("n").join(buckets, "bucket"), "members")
    grouped = members.groupBy("line").agg(F.collect_list(F.struct("bucket", "parts")).alias("of"))  # one a band at most
    bodies = docs.select("text").mapInArrow(wanted_batches(bloom(members.select("line").distinct())), "line bigint, body binary").groupBy("line").agg(F.first("body").alias("body"))
    held = written(grouped.join(bodies, "line"), "candidates")
    each = held.select("line", "body", F.col("of.bucket").alias("shared"), F.explode("of").alias("m")).select("line", "body", "shared", "m.*")
    own = F.pmod(F.xxhash64("line"), F.col("parts")).cast("int")
    links = written(compared(each.withColumns({"sub": own, "chunk": own, "label": F.col("line")}), similar), "links")
    large = each.where("parts > 1")
    if members.where("parts > 1").isEmpty():
        return links

    def labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
        found = written(components(links).select(F.col("node").alias("line"), F.col("component").alias("joined")), "labels")
        return rows.join(found, "line", "left").withColumn("label", F.coalesce("joined", "line")).drop("joined")

    row = F.struct("line", "body", "shared")
    ones = labelled(large, links).groupBy("bucket", "parts", own.alias("own"), "label").agg(F.min_by(row, "line").alias("r")).select("bucket", "parts", "label", "r.*")
    ones = written(ones, "ones")
    needed = ones.groupBy("bucket").agg(F.ceil(F.count("*") / chunk).cast("int").alias("needed"))
    second = F.pmod(F.xxhash64("line", "bucket"), F.col("needed")).cast("int")
    links = written(links.unionByName(compared(ones.join(needed, "bucket").withColumns({"sub": second, "chunk": second}), similar)), "links")
    apart = written(labelled(large, links), "apart")
    several = apart.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    pairs = apart.join(several, "bucket", "left_semi").withColumn("chunk", own).select("*", other.alias("other"))
    pairs = pairs.withColumn("sub", (F.least("chunk", "other") * F.col("parts") + F.greatest("chunk", "other")))
    return links.unionByName(compared(pairs, similar))


def line_verdicts(docs: DataFrame, similar: float = SIMILAR, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, tid, line_no, line, component, kept): every line that holds a word, kept where it is its component's first.

    Lines are the \\n-split parts of the whole texts, compared with A-Z lower-cased; equal lines are one
    (by a 64-bit hash), lines at Jaccard `similar` or more over shingles of eight code points are linked
    when they share one of 9 bands of 4 (0.8: found with 99 %). The first line by (doc_id, tid, line_no)
    of a component stays, tid being a hash of the text that tells rows with one doc_id apart; NULL
    doc_ids come first. Rows equal in doc_id and text are one document. Lines without a word and NULL or
    empty texts have no rows. An empty table gives an empty result. Texts and lines of any length are
    taken whole, their shingles a block at a time.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tid"))
    occurrences = written(keyed.mapInArrow(line_batches, f"doc_id {kind}, tid bigint, line_no bigint, line bigint, bands array<bigint>"), "lines")
    linked = components(similar_links(docs, occurrences, similar, chunk)).select(F.col("node").alias("line"), "component")
    place = F.struct("doc_id", "tid", "line_no")
    lines = occurrences.groupBy("line").agg(F.min(place).alias("at")).join(linked, "line", "left").withColumn("component", F.coalesce("component", "line"))
    lines = written(lines, "components")
    first = lines.groupBy("component").agg(F.min("at").alias("first"))
    named = lines.join(first, "component").select("line", "component", "first")
    return occurrences.drop("bands").join(named, "line").select("doc_id", "tid", "line_no", "line", "component", place.eqNullSafe(F.col("first")).alias("kept"))


def report(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, tid, n_lines, n_removed, removed): for every row, its lines with a word and the numbers of those dropped."""
    found = line_verdicts(docs, **how).groupBy(F.col("doc_id").alias("of"), F.col("tid").alias("of_tid")).agg(
        F.countDistinct("line_no").alias("n_lines"), F.array_sort(F.collect_set(F.when(~F.col("kept"), F.col("line_no")))).alias("removed")
    )
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tid"))
    return keyed.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tid") == F.col("of_tid")), "left").select(
        "doc_id", "tid", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed")
    )


def cut_batches(removed: str):
    """The rows without the lines of the numbers in the column `removed`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            numbers = part.column(removed)
            if numbers.null_count < len(numbers):
                texts = part.column("text").to_pylist()
                for k, some in enumerate(numbers.to_pylist()):
                    if some:
                        gone = set(some)
                        texts[k] = "\n".join(x for i, x in enumerate(texts[k].split("\n")) if i not in gone)
                part = part.set_column(part.schema.get_field_index("text"), part.schema.field("text"), pa.array(texts, part.schema.field("text").type))
            yield part

    return run


@any_names
def drop_lines(docs: DataFrame, **how) -> DataFrame:
    """`docs` with duplicate lines cut out; a document that loses all its lines goes; n_chars follows where it exists.

    Rows are told apart by doc_id and text, so rows that share a doc_id lose only their own lines.
    Documents that had no line with a word, NULL and empty ones too, stay as they are; an empty table
    stays empty; columns of any other name stay.
    """
    of, of_tid, removed, gone = names = [unused(c, docs.columns) for c in ("of", "of_tid", "removed", "gone")]
    found = report(docs, **how).where("n_removed > 0").dropDuplicates(["doc_id", "tid"])
    found = found.select(F.col("doc_id").alias(of), F.col("tid").alias(of_tid), F.col("removed").alias(removed), (F.col("n_removed") == F.col("n_lines")).alias(gone))
    both = docs.join(found, F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(of_tid)), "left").where(~F.coalesce(F.col(gone), F.lit(False)))
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in both.schema)
    both = both.mapInArrow(cut_batches(removed), kinds)
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.col(removed).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return both.drop(*names).select(docs.columns)
