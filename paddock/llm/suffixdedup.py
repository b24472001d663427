"""Exact substring dedup with a column-wise collection Burrows-Wheeler transform.

Every `length`-byte window belongs to one anchor, the least-hashed short string inside it, so equal
windows have equal anchors. Anchors found once can't hold a repeat. The windows that one occurrence of a
repeated anchor owns are adjacent and form a segment; segments of an anchor meet in one shard, where the
transform of the collection is built one symbol per segment and round, and its common prefixes of
`length` or more tell equal windows.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, bloom, flat, gram_hash, may_hold, mix, partitions, text_slices, written
from .quality import repeated

LENGTH, SHARD, HOT = 100, 20_000, 200_000
PIECE = 1 << 20  # bytes from which a slice is taken in overlapping pieces
PLACE = 24  # bits of a position within a piece
ROWS = 1 << 17  # rows of the transform's columns read at once; their arrays stay in the cache


def gram_of(length: int) -> int:
    """Bytes of an anchor: long enough that few repeat by chance, short enough that few are needed."""
    return max(1, length * 48 // 100)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(hash, first window, windows owned, text, bytes from the first window to the anchor) of every anchor."""
    none = np.zeros(0, np.int64)
    grams = gram_hash(data, gram_of(length))
    width = length - gram_of(length) + 1
    n = len(grams) - width + 1
    if n <= 0:
        return grams[:0], none, none, none, none
    low = np.uint64((1 << PLACE) - 1)
    least, have = (grams & ~low) | np.arange(len(grams), dtype=np.uint64), 1
    while have < width:
        step = min(have, width - have)
        least, have = np.minimum(least[: len(least) - step], least[step:]), have + step
    sizes = np.diff(offsets)
    of = np.repeat(np.arange(len(sizes)), sizes)[:n]
    whole = np.arange(n) + length <= offsets[of + 1]
    window = np.flatnonzero(whole)
    at = (least[window] & low).astype(np.int64)
    new = np.concatenate([[True], (np.diff(at) != 0) | (np.diff(of[window]) != 0)]) if len(window) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    owned = np.diff(np.concatenate([first, [len(window)]]))
    return grams[at[first]], window[first], owned, of[window[first]], at[first] - window[first]


def pieces(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bytes, offsets, place of each text's first byte within it, its row): the texts at once, or a long one in pieces that share all but the first windows."""
    data, offsets = flat(column)
    if len(data) <= PIECE:
        yield data, offsets, np.zeros(len(column), np.int64), np.arange(len(column))
        return
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for at in range(0, max(1, b - a - length + 1), PIECE):
            part = data[a + at : min(b, a + at + PIECE + length - 1)]
            yield part, np.array([0, len(part)]), np.array([at]), np.array([row])


def count_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found = [anchors(data, offsets, length)[0] for data, offsets, _, _ in pieces(part.column("text"), length)]
            found, times = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], ["anchor", "n"])

    return run


def range_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """128 bits of each byte range, from two hashes."""
    both = np.stack([RangeHash(data, seed)(starts, ends) for seed in (1, 2)], axis=1)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.arange(len(starts) + 1, dtype=np.int32) * 16), pa.py_buffer(both.tobytes())])


def digest(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


STEP = 1_000_003  # spreads the starts of segments of one document over keys


def segment_batches(length: int, words, bodies: bool = False, digests: bool = True):
    """Segments: anchor, first window, windows, bytes before the anchor, and on request their digests or bytes.

    Of anchors that may be in the bit array, or with `bodies` of segments whose key may be in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            for data, offsets, base, row in pieces(part.column("text"), length):
                found = anchors(data, offsets, length)
                key, place = found[0].view(np.int64), base[found[3]] + found[1] - offsets[found[3]]
                if bodies:
                    key = part.column("key").to_numpy()[row[found[3]]] ^ (place * STEP)
                may = np.flatnonzero(may_hold(words.value, key))
                hashed, first, owned, of, lead = (x[may] for x in found)
                where = pa.array(row[of])
                columns = [part.column("doc_id").take(where), part.column("tid").take(where), pa.array(hashed.view(np.int64)), pa.array(place[may]), pa.array(owned), pa.array(lead)]
                names = ["doc_id", "tid", "anchor", "start", "owned", "lead"]
                if bodies or digests:
                    last = first + owned + length - 1
                    if bodies:
                        columns.append(pa.array([data[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary()))
                    else:
                        columns.append(range_digests(data, first, last))
                    names.append("body" if bodies else "digest")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def cut_segments(length: int):
    """The digests of listed segments of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            of, rows = [], []
            for k, (text, found) in enumerate(zip(part.column("text").to_pylist(), part.column("found").to_pylist(), strict=True)):
                raw = text.encode()
                for x in found:
                    body = raw[x["start"] : x["start"] + x["owned"] + length - 1]
                    of.append(k)
                    rows.append((x["anchor"], x["start"], x["owned"], x["lead"], digest(body)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            where = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(where), part.column("tid").take(where), *columns], ["doc_id", "tid", "anchor", "start", "owned", "lead", "digest"])

    return run


def upto(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The least of the values up to and at each place."""
    ends, which = np.unique(places + 1, return_inverse=True)
    if not len(ends):
        return ends
    edges = np.append(0, ends[:-1])
    return np.minimum.accumulate(np.minimum.reduceat(values[: ends[-1]], edges).astype(np.int64))[which]


def beyond(values: np.ndarray, places: np.ndarray, none: int) -> np.ndarray:
    """The least of the values after each place; `none` after the last."""
    starts, which = np.unique(places + 1, return_inverse=True)
    inside = starts[starts < len(values)]
    least = np.full(len(starts), none, np.int64)
    if len(inside):
        least[: len(inside)] = np.minimum.accumulate(np.minimum.reduceat(values, inside).astype(np.int64)[::-1])[::-1]
    return least[which]


class CollectionBWT:
    """Transform and common prefixes of a collection, grown by one symbol of each string a round.

    The columns (symbol before, common prefix with the row above, string and suffix length) are files.
    A round reads them from front to back twice, `rows` at a time, and writes them anew: first it finds
    where the live strings' longer suffixes go, then it merges those in. In memory are one block, what
    each symbol carries from block to block, and the live strings with their places.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray, folder: str, rows: int = ROWS):
        self.turn, self.rows = 0, rows
        symbols = np.unique(data)
        if len(symbols) > 255:
            raise ValueError("255 different bytes at most; UTF-8 has fewer")
        longest = int(sizes.max(initial=0))
        self.bits = longest.bit_length()
        kind = np.uint8 if longest < 255 else np.uint16 if longest < 65535 else np.uint32
        self.columns = {"bwt": np.uint8, "lcp": kind, "suffix": np.int32 if len(sizes) << self.bits < 1 << 31 else np.int64}
        code = np.zeros(256, np.uint8)
        code[symbols] = np.arange(1, len(symbols) + 1)
        coded, last = code[data], np.cumsum(sizes) - 1
        n = self.n = self.size = len(sizes)
        before = lambda live, k: np.where(sizes[live] > k, coded[np.maximum(last[live] - k, 0)], 0).astype(np.uint8)
        at = live = np.arange(n)
        self.counts = np.zeros(len(symbols) + 1, np.int64)  # of each symbol in the transform
        first = before(live, 0)
        self.add(first)
        # every column has two files, read and overwritten by turns
        self.files = [{name: open(Path(folder) / f"{name}{k}", "w+b", buffering=0) for name in self.columns} for k in range(2)]
        for name, column in zip(self.columns, (first, np.zeros(n), live << self.bits), strict=True):
            self.files[0][name].write(column.astype(self.columns[name]))
        for k in range(1, longest + 1):
            still = sizes[live] >= k
            live, at = self.insert(k, live[still], at[still], before)

    def add(self, symbols: np.ndarray) -> None:
        self.counts += np.bincount(symbols, minlength=len(self.counts))

    def read(self, *names: str) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first row, columns) block by block."""
        for name in names:
            self.files[self.turn][name].seek(0)
        for low in range(0, self.size, self.rows):
            block = [np.empty(min(self.rows, self.size - low), self.columns[name]) for name in names]
            for name, column in zip(names, block, strict=True):
                if self.files[self.turn][name].readinto(column.view(np.uint8)) != column.nbytes:
                    raise OSError("a column's file is shorter than the column")
            yield low, block

    def close(self) -> None:
        for f in (f for pair in self.files for f in pair.values()):
            f.close()

    def whole(self, name: str) -> np.ndarray:
        return np.concatenate([x for _, (x,) in self.read(name)]) if self.size else np.zeros(0, self.columns[name])

    def insert(self, k: int, live: np.ndarray, at: np.ndarray, before) -> tuple[np.ndarray, np.ndarray]:
        """Insert the suffixes of length k of the live strings, whose shorter ones are at the rising rows `at`."""
        rank, above, below = self.places(at)
        new = self.n + rank - self.counts[0]
        by = np.argsort(new)
        live, new, above, below = live[by], new[by], above[by], below[by]
        self.merge(new, before(live, k), live << self.bits | k, above, below)
        return live, new

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the rows `at`: rank by symbol and row, and the common prefixes of the longer suffix with those above and below it (-1: none)."""
        starts = np.cumsum(self.counts) - self.counts
        none = np.iinfo(np.int64).max
        held, since = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64)  # occurrences so far; least prefix since the last
        waiting, ahead = np.full(len(starts), -1), np.zeros(len(starts), np.int64)  # the live row that waits for a next occurrence; least prefix since
        rank, above, below = np.empty(len(at), np.int64), np.full(len(at), -1, np.int64), np.full(len(at), -1, np.int64)
        cuts = np.searchsorted(at, np.arange(0, self.size + self.rows, self.rows))
        for block, (low, (bwt, lcp)) in enumerate(self.read("bwt", "lcp")):
            mine = slice(cuts[block], cuts[block + 1])
            here, size = at[mine] - low, len(bwt)
            order = np.argsort(bwt, kind="stable").astype(np.int32)
            place = np.empty(size, np.int32)
            place[order] = np.arange(size, dtype=np.int32)
            times = np.bincount(bwt, minlength=len(starts))
            first = np.cumsum(times) - times
            r, symbol = place[here].astype(np.int64), bwt[here]
            rank[mine] = starts[symbol] + held[symbol] + r - first[symbol]
            up, down = order[np.maximum(r - 1, 0)].astype(np.int64), order[np.minimum(r + 1, size - 1)].astype(np.int64)
            has_up, has_down = r > first[symbol], r + 1 < first[symbol] + times[symbol]
            ext = np.append(lcp, lcp.dtype.type(0))

            def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                """The least of the rows a .. b - 1; ranges in order, so that gaps between them add up to the block at most."""
                by = np.argsort(a, kind="stable")
                out = np.empty(len(a), np.int64)
                if len(a):
                    out[by] = np.minimum.reduceat(ext, np.stack([a[by], b[by]], axis=1).reshape(-1))[::2]  # noqa: B023
                return out

            over, under = np.full(len(here), -1, np.int64), np.full(len(here), -1, np.int64)
            over[has_up] = least(up[has_up] + 1, here[has_up] + 1)
            under[has_down] = least(here[has_down] + 1, down[has_down] + 1)
            if self.size > size:  # more blocks than one: what symbols carry over the edges
                some = np.flatnonzero(times)
                head, tail = order[first[some]].astype(np.int64), order[first[some] + times[some] - 1].astype(np.int64)
                met = waiting[some] >= 0
                early, last = np.flatnonzero(~has_up & (since[symbol] >= 0)), np.flatnonzero(~has_down)
                over[early] = np.minimum(since[symbol[early]], upto(lcp, here[early]))
                below[waiting[some[met]]] = np.minimum(ahead[some[met]], upto(lcp, head[met]))
                waiting[some] = -1
                low_here = int(lcp.min())
                ahead = np.minimum(ahead, low_here)
                waiting[symbol[last]], ahead[symbol[last]] = last + cuts[block], beyond(lcp, here[last], none)
                since = np.where(since >= 0, np.minimum(since, low_here), since)
                since[some] = beyond(lcp, tail, none)
            held += times
            above[mine], below[mine] = over, under
        return rank, above, below

    def merge(self, new: np.ndarray, symbols: np.ndarray, suffixes: np.ndarray, above: np.ndarray, below: np.ndarray) -> None:
        """Write the columns with the new rows; the prefix of a row below a new one changes, too."""
        old = new - np.arange(len(new))  # before which old row each new one goes
        after = np.flatnonzero((below >= 0) & (np.append(new[1:], -1) != new + 1))  # the row below is an old one
        fresh = np.where(above >= 0, above + 1, 0)
        follow = np.flatnonzero((below[:-1] >= 0) & (new[1:] == new[:-1] + 1)) if len(new) else after
        fresh[follow + 1] = below[follow] + 1
        values = dict(zip(self.columns, (symbols, fresh, suffixes), strict=True))
        files = self.files[self.turn ^ 1]
        for f in files.values():
            f.seek(0)
        for low, block in self.read(*self.columns):
            size = len(block[0])
            a, b = np.searchsorted(old, low), np.searchsorted(old, low + size) if low + size < self.size else len(old)
            at = new[a:b] - (low + a)
            kept = np.ones(size + b - a, bool)
            kept[at] = False
            for name, column in zip(self.columns, block, strict=True):
                if name == "lcp":
                    changed = after[(old[after] >= low) & (old[after] < low + size)]
                    column[old[changed] - low] = below[changed] + 1
                out = np.empty(len(kept), column.dtype)
                out[kept] = column
                out[at] = values[name][a:b]
                files[name].write(out)
        self.turn, self.size = self.turn ^ 1, self.size + len(new)
        self.add(symbols)

    def repeats(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, string, suffix length) of the suffixes that share a prefix of `length` or more with another."""
        deep = self.whole("lcp") >= length
        rows = np.flatnonzero(deep | np.concatenate([deep[1:], [False]]))
        suffix = self.whole("suffix")[rows].astype(np.int64)
        return np.cumsum(~deep)[rows], suffix >> self.bits, suffix & ((1 << self.bits) - 1)


def shard_batches(length: int, shard: int):
    """Anchors in order, `shard` segments or more at a time: spans of windows that start earlier elsewhere."""

    def spans(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        bodies, gram = table.column("body").to_pylist(), gram_of(length)
        sizes, lead = np.array([len(x) for x in bodies]), table.column("lead").to_numpy()
        data = np.frombuffer(b"".join(bodies), np.uint8).copy()
        # the anchor, common to all strings of its group, is one symbol that no UTF-8 text has
        head = np.cumsum(sizes) - sizes + lead
        data[head] = 255
        inner = np.zeros(len(data) + 1, np.int8)
        inner[head + 1] += 1
        inner[head + gram] -= 1
        with tempfile.TemporaryDirectory() as folder:
            transform = CollectionBWT(data[np.cumsum(inner)[:-1] == 0], sizes - gram + 1, folder)
            kind, string, size = transform.repeats(length - gram + 1)
            transform.close()
        start, tid, anchor = (table.column(c).to_numpy() for c in ("start", "tid", "anchor"))
        doc, group = dense(table.column("doc_id")), np.unique(anchor, return_inverse=True)[1]
        offset = (sizes - gram + 1)[string] - size
        kind = kind * (len(sizes) + 1) + group[string]
        place = doc[string], start[string] + offset, tid[string]
        by = np.lexsort((*place[::-1], kind))
        opens = np.concatenate([[True], kind[by][1:] != kind[by][:-1]]) if len(by) else np.zeros(0, bool)
        first = by[np.maximum.accumulate(np.where(opens, np.arange(len(by)), 0))]
        later = np.zeros(len(by), bool)
        for x in place:  # a row given twice has the place of the first
            later |= x[by] != x[first]
        s, o = string[by][later], offset[by][later]
        by = np.lexsort((o, s))
        s, o = s[by], o[by]
        head = np.flatnonzero(np.concatenate([[True], (np.diff(s) != 0) | (np.diff(o) != 1)])) if len(s) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate([head, [len(s)]]))
        where = pa.array(s[head])
        return pa.RecordBatch.from_arrays(
            [table.column("doc_id").combine_chunks().take(where), pa.array(tid[s[head]]), pa.array(start[s[head]] + o[head]), pa.array(times + length - 1)], ["doc_id", "tid", "start", "size"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, tail = [], 0, None
        for batch in batches:
            if tail is not None:
                batch = pa.concat_batches([tail, batch]) if tail.num_rows else batch
            anchor = batch.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0  # the last anchor may go on
            tail = batch.slice(cut)
            ready = several(batch.slice(0, cut), length)
            if ready.num_rows:
                held.append(ready)
                count += ready.num_rows
            if count >= shard:
                yield spans(held)
                held, count = [], 0
        if tail is not None and (ready := several(tail, length)).num_rows:
            held.append(ready)
        if held:
            yield spans(held)

    return run


def several(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """The rows that may share a window with another of their anchor; rows come in order of anchors.

    A window holds its anchor with the `side` bytes before it or the `side` bytes after it. So equal
    windows need another segment with the same of the one or of the other.
    """
    if not batch.num_rows:
        return batch
    anchor, lead = batch.column("anchor").to_numpy(), batch.column("lead").to_numpy()
    same = anchor[1:] == anchor[:-1]
    rows = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    if not len(rows):
        return batch.slice(0, 0)
    batch, anchor, lead = batch.take(pa.array(rows)), anchor[rows].view(np.uint64), lead[rows]
    bodies = batch.column("body").to_pylist()
    sizes = np.array([len(x) for x in bodies])
    begin = np.cumsum(sizes) - sizes
    hashed = RangeHash(np.frombuffer(b"".join(bodies), np.uint8))
    gram, side = gram_of(length), (length - gram_of(length)) // 2
    sides = []
    for has, a, b in ((lead >= side, lead - side, lead + gram), (sizes - lead - gram >= side, lead, lead + gram + side)):
        own, again = np.flatnonzero(has), np.zeros(len(rows), bool)
        again[own] = repeated(mix(hashed(begin[own] + a[own], begin[own] + b[own]) + anchor[own] * np.uint64(0xD1342543DE82EF95)))[0]
        sides.append(again)
    before, after = sides
    # windows that reach far to a side that no other segment has are cut off
    front = np.where(before, 0, np.maximum(lead - side + 1, 0))
    back = np.where(after, sizes, np.minimum(sizes, lead - side + length))
    kept = np.flatnonzero((before | after) & (back - front >= length))
    cut = [bodies[i][a:b] for i, a, b in zip(kept.tolist(), front[kept].tolist(), back[kept].tolist(), strict=True)]
    batch, front = batch.take(pa.array(kept)), front[kept]
    changed = {"body": pa.array(cut, pa.binary()), "lead": pa.array(lead[kept] - front), "start": pa.array(batch.column("start").to_numpy() + front)}
    return pa.RecordBatch.from_arrays([changed.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)


def dense(column: pa.ChunkedArray) -> np.ndarray:
    """Ranks of values, NULL first."""
    values = column.to_pylist()
    place = {v: k for k, v in enumerate(sorted({v for v in values if v is not None}))}
    return np.array([-1 if v is None else place[v] for v in values], np.int64)


def collapsed(segments: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(spans of all but the first of equal segments, the first ones); other columns go with the first."""
    place, own = F.struct("doc_id", "start", "tid"), ["anchor", "digest", "doc_id", "start", "tid"]
    kept = [c for c in segments.columns if c not in own]
    firsts = written(segments.groupBy("anchor", "digest").agg(F.min(place).alias("at"), *[F.first(c).alias(c) for c in kept]), "firsts")
    later = segments.select(own).join(firsts.select("anchor", "digest", "owned", "at"), ["anchor", "digest"]).where(~place.eqNullSafe(F.col("at")))
    return later.select("doc_id", "tid", "start", (F.col("owned") + length - 1).alias("size")), firsts.select("anchor", *kept, "at.*")


def parted(segments: DataFrame, length: int, windows: bool) -> DataFrame:
    """Segments of hot anchors cut up, each part with an anchor of its own that equal windows share.

    Every window holds its anchor with the `side` bytes before it or else with those after it: the
    windows of a segment with the former make one part, the rest another, and those bytes join the
    anchor's hash. With `windows` each window is a part.
    """
    gram = gram_of(length)
    side = (length - gram) // 2
    lead, owned = F.col("lead"), (F.octet_length("body") - length + 1).cast("long")
    part = lambda a, n, context, name: F.struct(a.cast("long").alias("a"), n.cast("long").alias("n"), F.xxhash64("anchor", F.lit(name), context).alias("key"))
    cut = lambda at, n: F.substring("body", (at + 1).cast("int"), n)
    if windows:
        parts = F.transform(F.sequence(F.lit(0).cast("long"), owned - 1), lambda k: part(k, F.lit(1), cut(k, F.lit(length)), "window"))
    else:
        before = F.least(owned, F.greatest(lead - side + 1, F.lit(0)))
        parts = F.array(part(F.lit(0), before, cut(lead - side, F.lit(side)), "before"), part(before, owned - before, cut(lead + gram, F.lit(side)), "after"))
    each = segments.select("*", F.explode(parts).alias("p")).where("p.n > 0")
    body = F.substring("body", (F.col("p.a") + 1).cast("int"), (F.col("p.n") + length - 1).cast("int"))
    return each.select("doc_id", "tid", F.col("p.key").alias("anchor"), (F.col("start") + F.col("p.a")).alias("start"), F.col("p.n").alias("owned"), (lead - F.col("p.a")).alias("lead"), F.md5(body).cast("binary").alias("digest"), body.alias("body"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, most_bits: int = 1 << 27, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """texts(doc_id, tid, text) -> (doc_id, tid, start, size): byte spans covered by windows that start earlier elsewhere."""
    kind, n = texts.schema["doc_id"].dataType.simpleString(), partitions(texts.sparkSession)
    counted = texts.select("text").mapInArrow(count_batches(length), "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    several_times = written(counted.where("n > 1").select("anchor"), "anchors")
    words = bloom(several_times, most_bits)
    narrow = f"doc_id {kind}, tid bigint, anchor bigint, start bigint, owned bigint, lead bigint"
    if len(words.value) * 64 < most_bits:
        # few enough anchors for a bit array that lets hardly any other through; one that passes meets no partner
        segments = texts.mapInArrow(segment_batches(length, words), f"{narrow}, digest binary")
    else:
        found = texts.mapInArrow(segment_batches(length, words, digests=False), narrow).join(several_times, "anchor")
        found = found.groupBy(F.col("doc_id").alias("of"), F.col("tid").alias("of_tid")).agg(F.collect_list(F.struct("anchor", "start", "owned", "lead")).alias("found"))
        both = texts.dropDuplicates(["doc_id", "tid"]).join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tid") == F.col("of_tid")))
        segments = both.select("doc_id", "tid", "text", "found").mapInArrow(cut_segments(length), f"{narrow}, digest binary")
    copies, firsts = collapsed(written(segments.drop("lead"), "segments"), length)
    # the bytes of first segments of anchors with different ones; what else passes the bit array is a copy or has no partner
    by_anchor = written(firsts.groupBy("anchor").count().where("count > 1"), "several")
    key = F.xxhash64("doc_id", "tid")
    wanted = firsts.join(by_anchor, "anchor", "left_semi").select(key.bitwiseXOR(F.col("start") * STEP).alias("key"))
    bodies = texts.withColumn("key", key).mapInArrow(segment_batches(length, bloom(wanted, most_bits), bodies=True), f"{narrow}, body binary")
    # an anchor with very many different segments is split by what stands beside it, and what is hot still, by whole windows
    large = written(by_anchor.where(F.col("count") > hot).select("anchor"), "large")
    columns = ["anchor", "body", "lead", "doc_id", "start", "tid"]
    rest, spans = bodies.join(large, "anchor", "left_anti").select(columns), copies
    hotter = bodies.join(large, "anchor", "left_semi").select(columns)
    for kind_of in ("side", "window"):
        more, firsts = collapsed(written(parted(hotter, length, kind_of == "window"), kind_of), length)
        spans = spans.unionByName(more)
        if kind_of == "side":
            still = written(firsts.groupBy("anchor").count().where(F.col("count") > hot).select("anchor"), "still")
            rest = rest.unionByName(firsts.join(still, "anchor", "left_anti").select(columns))
            hotter = firsts.join(still, "anchor", "left_semi").select(columns)
        else:
            rest = rest.unionByName(firsts.select(columns))
    rest = rest.repartition(n, "anchor").sortWithinPartitions("anchor")
    same = rest.mapInArrow(shard_batches(length, shard), f"doc_id {kind}, tid bigint, start bigint, size bigint")
    return spans.unionByName(same)


def plain_batches(words):
    """Sizes and hashes of whole texts; the text itself goes on only where spans may be cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            raw = [t.encode() for t in part.column("text").to_pylist()]
            may = may_hold(words.value, part.column("key").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("tid"), pa.array([len(x) for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
                    pa.array([x if m else None for x, m in zip(raw, may.tolist(), strict=True)], pa.binary()),
                ],
                ["doc_id", "tid", "n_bytes", "kept_sha256", "raw"],
            )

    return run


def union_spans(starts: list[int], sizes: list[int]) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, [x + y for x, y in zip(starts, sizes, strict=True)], strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def final_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        removed, spans, sha, kept_text = [], [], part.column("kept_sha256").to_pylist(), []
        for k, (raw, starts, sizes) in enumerate(zip(*(part.column(c).to_pylist() for c in ("raw", "starts", "sizes")), strict=True)):
            runs = union_spans(starts or [], sizes or [])
            removed.append(sum(b - a for a, b in runs))
            spans.append(runs)
            if runs:
                edges = [0, *[x for r in runs for x in r], len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                sha[k] = hashlib.sha256(kept).hexdigest()
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"), part.column("n_bytes"), pa.array(removed, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(sha, pa.string()),
                pa.array([[list(r) for r in x] for x in spans], pa.list_(pa.list_(pa.int64()))),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def dedup_substrings(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges removed) for every row of `docs`.

    A byte goes when a `length`-byte string over it also starts earlier: in a smaller doc_id, or earlier
    in the same document. NULL is the empty text; texts under `length` bytes stay whole. Rows equal in
    doc_id and text are one document and get equal results; other rows that repeat a doc_id are told
    apart by a hash of the text, which then breaks ties of equal starts. A NULL doc_id is the smallest.
    An empty table gives an empty result. Other columns are ignored.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    spans = repeated_spans(texts, length, **how)
    spans = written(spans.groupBy("doc_id", "tid").agg(F.collect_list("start").alias("starts"), F.collect_list("size").alias("sizes")), "spans")
    key = F.xxhash64("doc_id", "tid").alias("key")
    words = bloom(spans.select(key).distinct())
    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = texts.select("doc_id", "tid", "text", key).mapInArrow(plain_batches(words), f"doc_id {kind}, tid bigint, n_bytes bigint, kept_sha256 string, raw binary")
    spans = spans.withColumnRenamed("doc_id", "of").withColumnRenamed("tid", "of_tid")
    both = plain.join(spans, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tid") == F.col("of_tid")), "left").select("doc_id", "n_bytes", "kept_sha256", "raw", "starts", "sizes")
    return both.mapInArrow(final_batches, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<array<bigint>>")


def brute_force(texts: dict[int, bytes], length: int) -> dict[int, tuple[int, int, str]]:
    """(removed, spans, sha256) of each text by a table of all windows; for tests."""
    seen: set[bytes] = set()
    out = {}
    for doc in sorted(texts):
        raw, gone = texts[doc], bytearray(len(texts[doc]))
        for i in range(len(raw) - length + 1):
            if (w := raw[i : i + length]) in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        edges = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = sum(gone), edges, hashlib.sha256(kept).hexdigest()
    return out
