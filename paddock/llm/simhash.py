"""SimHash near-dedup: tiled exact comparison of 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, partitions, unused, words, written
from .components import LocalSets, components

TILE_ROWS = 4096


def fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The majority bit of every list of hashes, 64 positions at a time."""
    for whole in batches:
        lengths = pc.list_value_length(whole.column("hashes")).to_numpy(zero_copy_only=False)
        edges = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(lengths) // 500_000)) + 1, [len(lengths)]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = whole.slice(a, b - a)
            hashes, sizes = part.column("hashes").flatten().to_numpy(zero_copy_only=False).view(np.uint64), lengths[a:b].astype(np.int64)
            out, some = np.zeros(len(sizes), np.uint64), sizes > 0
            if some.any():
                bits = np.unpackbits(np.ascontiguousarray(hashes).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                ones = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.int32)
                out[some] = np.packbits(2 * ones > sizes[some][:, None], axis=1).view(">u8")[:, 0]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): SimHash over the XXH64 (seed 42) of word shingles, repeats included; no word: 0."""
    w, n = F.col("w"), F.size("w")
    grams = F.when(n == 0, F.array().cast("array<bigint>")).when(n < shingle, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(
        F.transform(F.sequence(F.lit(1), n - shingle + 1), lambda i: F.xxhash64(F.concat_ws(" ", *[F.element_at(w, (i + k).cast("int")) for k in range(shingle)])))
    )
    hashed = docs.select("doc_id", words(lower_ascii(F.col("text"))).alias("w")).select("doc_id", grams.alias("hashes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return hashed.mapInArrow(fingerprint_batches, f"doc_id {kind}, fp bigint")


def segment_counts(fp: np.ndarray, segments: int) -> np.ndarray:
    """Population counts of each of `segments` equal stretches of the fingerprints."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return np.stack([np.bitwise_count((fp >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)], axis=1).astype(np.int64)


def steps(segments: int, radius: int) -> np.ndarray:
    """Half of the differences of count vectors within the radius: the null vector, then one of each pair v, -v."""
    found = {(0,) * segments}
    for _ in range(radius):
        found |= {tuple(v + d * (i == k) for k, v in enumerate(x)) for x in found for i in range(segments) for d in (-1, 1)}
    return np.array(sorted(x for x in found if x >= (0,) * segments))


def tile_batches(segments: int, radius: int):
    """Rows (tile, fp, probe): every fingerprint in its own tile, and as a probe in each later tile within the radius."""
    places, deltas = (64 // segments + 2) ** np.arange(segments)[::-1], steps(segments, radius)
    tops = np.array([64 * (i + 1) // segments - 64 * i // segments for i in range(segments)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 50_000):
                fp = whole.column("fp").slice(at, 50_000).to_numpy(zero_copy_only=False)
                counts = segment_counts(fp.view(np.uint64), segments)
                for delta in deltas:
                    near = counts + delta
                    there = ((near >= 0) & (near <= tops)).all(axis=1)
                    probe = np.full(int(there.sum()), bool(delta.any()))
                    yield pa.RecordBatch.from_arrays([pa.array(near[there] @ places), pa.array(fp[there]), pa.array(probe)], ["tile", "fp", "probe"])

    return run


def link_batches(radius: int):
    """Tile by tile, residents first: exact XOR and bit counts in blocks; links are thinned to a forest on the spot."""

    def links(residents: list[np.ndarray], probes: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own = np.concatenate(residents) if residents else np.zeros(0, np.uint64)
        sets = LocalSets(len(own))
        for at in range(0, len(own), 512):
            near = np.bitwise_count(own[at : at + 512, None] ^ own[None, at:]) <= radius
            for i in np.flatnonzero(near.sum(axis=1) > 1).tolist():
                sets.join_all(at + i, at + np.flatnonzero(near[i]))
        for fp in probes:
            for at in range(0, len(fp), 512):
                block = fp[at : at + 512]
                near = np.bitwise_count(block[:, None] ^ own[None, :]) <= radius
                hit = near.any(axis=1)
                if hit.any():
                    first = near.argmax(axis=1)
                    yield block[hit], own[first[hit]]
                    for i in np.flatnonzero(near.sum(axis=1) > 1).tolist():
                        sets.join_all(int(first[i]), np.flatnonzero(near[i]))
        roots = sets.roots()
        other = roots != np.arange(len(own))
        yield own[other], own[roots[other]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[tuple, bool, np.ndarray]]:
            for whole in batches:
                tile, sub, probe, fp = (whole.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "sub", "probe", "fp"))
                cuts = np.flatnonzero((np.diff(tile) != 0) | (np.diff(sub) != 0) | (np.diff(probe.astype(np.int8)) != 0)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tile)], strict=True):
                    if b > a:
                        yield (tile[a], sub[a]), bool(probe[a]), fp[a:b].view(np.uint64)

        coming, ahead = pieces(), []

        def take(key: tuple, probe: bool) -> Iterator[np.ndarray]:
            while True:
                if not ahead:
                    if (x := next(coming, None)) is None:
                        return
                    ahead.append(x)
                if ahead[0][0] != key or ahead[0][1] != probe:
                    return
                yield ahead.pop()[2]

        held_a, held_b, held = [], [], 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (held_a, held_b)], ["a", "b"])

        while ahead or (x := next(coming, None)) is not None:
            if not ahead:
                ahead.append(x)
            key = ahead[0][0]
            residents = list(take(key, False))
            for a, b in links(residents, take(key, True)):
                held_a.append(a)
                held_b.append(b)
                held += len(a)
            if held > 20_000:
                yield packed()
                held_a, held_b, held = [], [], 0
        if held_a:
            yield packed()

    return run


def segments_for(prints: int) -> int:
    """Stretches that keep the fullest tile of evenly spread prints near TILE_ROWS: its share is 0.0015, 3e-5 and 1.6e-7 for 4, 8 and 16."""
    return 4 if prints <= 2_000_000 else 8 if prints <= 100_000_000 else 16


def near_links(distinct: DataFrame, radius: int = 2, segments: int | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """distinct(fp) -> links (a, b) that connect all fingerprints at `radius` or fewer differing bits.

    A tile holds the fingerprints with the same population counts in `segments` stretches of the 64
    bits. Two fingerprints differ in at least as many bits as their counts differ in all, so pairs of
    tiles beyond the radius are skipped and the result is exact. A tile of more than `tile_rows` rows is
    split by hash, and its probes go to every part, so no task holds more than a part. By default the
    stretches grow in number with the fingerprints, so that tiles, not parts, take the growth.
    """
    segments = segments or segments_for(distinct.count())
    rows = distinct.mapInArrow(tile_batches(segments, radius), "tile bigint, fp bigint, probe boolean")
    large = (
        distinct.mapInArrow(tile_batches(segments, 0), "tile bigint, fp bigint, probe boolean").groupBy("tile").count()
        .where(F.col("count") > tile_rows).select("tile", F.ceil(F.col("count") / tile_rows).cast("int").alias("parts"))
    )
    large = written(large, "tiles")
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    # a resident stays in its part and probes the later ones of its own tile
    subs = F.when(F.col("probe"), F.sequence(F.lit(0), parts - 1)).otherwise(F.sequence(own, parts - 1))
    dealt = (
        rows.join(large, "tile", "left")
        .select("tile", "fp", "probe", own.alias("own"), F.explode(subs).alias("sub"))
        .select("tile", "sub", "fp", (F.col("probe") | (F.col("own") != F.col("sub"))).alias("probe"))
    )
    sorted_rows = dealt.repartition(partitions(distinct.sparkSession), "tile", "sub").sortWithinPartitions("tile", "sub", "probe")
    return sorted_rows.mapInArrow(link_batches(radius), "a bigint, b bigint")


def simhash_components(docs: DataFrame, radius: int = 2, shingle: int = 3, segments: int | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    component_id is the smallest doc_id reachable over links. Equal fingerprints are one node, so
    copies cost nothing further. NULL and empty texts have fingerprint 0 and link like any other; rows
    that repeat a doc_id give a row each; a NULL doc_id takes part but never names a component unless
    all its members are NULL. An empty table gives an empty result. Other columns are ignored.
    """
    prints = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    linked = components(near_links(nodes.select("fp"), radius, segments, tile_rows)).select(F.col("node").alias("fp"), "component")
    grouped = nodes.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The documents whose doc_id names their component; of rows that repeat that doc_id all stay."""
    kept_id = unused("kept_id", docs.columns)
    first = simhash_components(docs, **how).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept_id)).distinct()
    return docs.join(first, F.col("doc_id").eqNullSafe(F.col(kept_id)), "left_semi")


def brute_force(fps: dict[int, int], radius: int = 2) -> dict[int, int]:
    """Components of {doc_id: fingerprint} by comparing all pairs; for tests."""
    ids = sorted(fps)
    sets = LocalSets(len(ids))
    for i, j in combinations(range(len(ids)), 2):
        if (fps[ids[i]] ^ fps[ids[j]]).bit_count() <= radius:
            sets.join(i, j)
    return {d: ids[sets.root(i)] for i, d in enumerate(ids)}
