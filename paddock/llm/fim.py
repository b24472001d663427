"""Fill-in-the-middle: texts are cut between tokens and put together again in prefix-suffix-middle order.

The cuts are token ranks; their places come from a learned index of all token boundaries of the text: piecewise
linear segments whose error is bounded, and the residual of every boundary in one byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat, text_slices

# The sentinels of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK_BYTES = 1 << 20  # boundaries of a long text are worked out block by block
LEAST = 64  # ranks of the shortest segments
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


class RankIndex:
    """Rank of a boundary -> its offset. `append` takes rising offsets in any portions.

    A segment covers LEAST * 2^k ranks: neighbours of equal length are merged as long as one line leaves residuals of
    `error` at most. Lines run through the ends of a segment, shifted to the middle of their residuals. If even a
    shortest segment has larger ones (a step of some hundred bytes), its ranks have segments of their own.
    """

    def __init__(self, error: int = 127):
        self.error, self.n = min(error, 127), 0
        self.firsts, self.bases, self.slopes, self.residuals = [], [], [], []

    def append(self, offsets: np.ndarray) -> None:
        n = len(offsets)
        if not n:
            return
        size = LEAST
        whole = np.concatenate([offsets, np.full(-n % size, offsets[-1])]).astype(np.int64)
        starts, lengths = np.arange(0, len(whole), size), np.full(len(whole) // size, size)
        base, slope, fits = self.lines(whole.reshape(-1, size))
        while True:
            # a pair of fitting segments of the present size, the first at a multiple of twice that size
            pairs = np.flatnonzero((lengths[:-1] == size) & (lengths[1:] == size) & (starts[:-1] % (2 * size) == 0) & fits[:-1] & fits[1:])
            if not len(pairs):
                break
            size *= 2
            b, s, good = self.lines(whole[starts[pairs][:, None] + np.arange(size)])
            pairs, b, s = pairs[good], b[good], s[good]
            if not len(pairs):
                break
            base[pairs], slope[pairs], lengths[pairs] = b, s, size
            kept = np.ones(len(starts), bool)
            kept[pairs + 1] = False
            starts, lengths, base, slope, fits = starts[kept], lengths[kept], base[kept], slope[kept], fits[kept]
        if not fits.all():
            single = np.concatenate([np.arange(a, a + LEAST) for a in starts[~fits]])
            starts = np.concatenate([starts[fits], single])
            base, slope = np.concatenate([base[fits], whole[single].astype(float)]), np.concatenate([slope[fits], np.zeros(len(single))])
            order = np.argsort(starts)[: len(starts) - (len(whole) - n if not fits[-1] else 0)]
            starts, base, slope = starts[order], base[order], slope[order]
        ranks = np.arange(n)
        at = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(whole))))[:n]
        self.residuals.append((offsets - self.predicted(base[at], slope[at], ranks - starts[at])).astype(np.int8))
        self.firsts.append(starts + self.n)
        self.bases.append(base)
        self.slopes.append(slope)
        self.n += n

    @staticmethod
    def predicted(base: np.ndarray, slope: np.ndarray, steps: np.ndarray) -> np.ndarray:
        return np.floor(base + slope * steps + 0.5).astype(np.int64)

    def lines(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Base and slope of a line for each row of offsets, and whether its residuals are within the bound."""
        steps = np.arange(rows.shape[1])
        slope = (rows[:, -1] - rows[:, 0]) / max(1, rows.shape[1] - 1)
        off = rows - rows[:, :1] - slope[:, None] * steps
        base = rows[:, 0] + (off.max(axis=1) + off.min(axis=1)) / 2
        far = np.abs(rows - self.predicted(base[:, None], slope[:, None], steps)).max(axis=1)
        return base, slope, far <= self.error

    def done(self) -> RankIndex:
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.firsts, self.bases, self.slopes, self.residuals = joined(self.firsts, np.int64), joined(self.bases, float), joined(self.slopes, float), joined(self.residuals, np.int8)
        return self

    def __getitem__(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets of ranks: predicted, then corrected."""
        at = np.searchsorted(self.firsts, ranks, side="right") - 1
        return self.predicted(self.bases[at], self.slopes[at], ranks - self.firsts[at]) + self.residuals[ranks]


def boundaries(data: np.ndarray, first: int, last: int, starts: np.ndarray) -> np.ndarray:
    """Offsets in [first, last) at which a token begins; `starts` are the places at which texts begin."""
    part = data[first:last]
    letter = LETTER[part]
    begins = (part & 0xC0) != 0x80
    inner = letter.copy()
    inner[1:] &= letter[:-1]
    if len(part):
        inner[0] &= first > 0 and bool(LETTER[data[first - 1]])
    inner[starts[(starts >= first) & (starts < last)] - first] = False
    return np.flatnonzero(begins & ~inner) + first


def indexed(data: np.ndarray, offsets: np.ndarray, error: int = 127) -> tuple[RankIndex, np.ndarray]:
    """The index of all token boundaries of the texts in `data`, and the rank of the first one of each text and of the end.

    The end of the data is the last boundary, so that a cut after the last token has a place too.
    """
    index, ranks, starts = RankIndex(error), np.zeros(len(offsets), np.int64), np.unique(offsets[:-1])
    for a in range(0, len(data), BLOCK_BYTES):
        b = min(len(data), a + BLOCK_BYTES)
        found = boundaries(data, a, b, starts)
        inside = (offsets >= a) & (offsets < b)
        ranks[inside] = index.n + np.searchsorted(found, offsets[inside])
        index.append(found)
    ranks[offsets == len(data)] = index.n
    index.append(np.array([len(data)]))
    return index.done(), ranks


def transformed(batches: Iterator[pa.RecordBatch], percent: int, spm_percent: int) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        data, offsets = flat(batch.column("text"))
        index, ranks = indexed(data, offsets)
        n = np.diff(ranks)
        h = [batch.column(f"h{k}").to_numpy(zero_copy_only=False) for k in range(1, 5)]
        one, two = h[0] % (n + 1), h[1] % (n + 1)
        cuts = np.stack([offsets[:-1], index[ranks[:-1] + np.minimum(one, two)], index[ranks[:-1] + np.maximum(one, two)], offsets[1:]], axis=1)
        forms, outputs, chars = [], [], np.zeros((len(n), 2), np.int64)
        for k, (a, b, c, d) in enumerate(cuts.tolist()):
            text = data[a:d].tobytes()
            if not text or h[2][k] % 100 >= percent or any(s.encode() in text for s in (PREFIX, SUFFIX, MIDDLE)):
                forms.append("plain")
                outputs.append(text)
                continue
            prefix, middle, suffix = text[: b - a], text[b - a : c - a], text[c - a :]
            chars[k] = [np.count_nonzero((data[x:y] & 0xC0) != 0x80) for x, y in ((a, b), (b, c))]
            spm = h[3][k] % 100 < spm_percent
            forms.append("spm" if spm else "psm")
            parts = [SUFFIX.encode(), suffix, PREFIX.encode(), prefix] if spm else [PREFIX.encode(), prefix, SUFFIX.encode(), suffix]
            outputs.append(b"".join([*parts, MIDDLE.encode(), middle]))
        plain = np.array([f == "plain" for f in forms], bool)
        columns = [batch.column("doc_id"), pa.array(n), pa.array(forms, pa.string()), pa.array(chars[:, 0], mask=plain), pa.array(chars[:, 1], mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, percent: int = 90, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document.

    Tokens are runs of A-Z and a-z and single other code points; the text is cut at two boundaries drawn by the sha256
    of `seed:doc_id`. NULL and empty texts, texts that contain a sentinel, and a share of 100 - `percent` stay plain,
    with NULL chars. Rows are independent: equal doc_ids are cut by the same draws, a NULL doc_id counts as an empty
    one, an empty table gives an empty result, other columns are left out whatever their names. Of a long text only the
    bytes, a byte a token and the segments are held; its boundaries are made in blocks of 1 MB. No shuffle.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select("doc_id", "text", *draws).mapInArrow(lambda batches: transformed(batches, percent, spm_percent), schema)


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form alone."""
    first, second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.lit(MIDDLE)
    body = F.substr(output, F.lit(4))
    head = F.call_function("substring_index", body, first, F.lit(1))
    rest = F.substr(body, F.length(head) + 4)
    tail = F.call_function("substring_index", rest, second, F.lit(1))
    middle = F.substr(rest, F.length(tail) + 4)
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))


def digests(docs: DataFrame) -> DataFrame:
    made = fill_in_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as w, sha256('1:' || doc_id) as h from documents),
r as (select *, len(w)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
             case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from r),
p as (select *, array_to_string(w[1:a], '') as prefix, array_to_string(w[a + 1:b], '') as middle, array_to_string(w[b + 1:], '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix)::bigint end as prefix_chars, case when form <> 'plain' then length(middle)::bigint end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from p
"""
