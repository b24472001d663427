"""PII: overlapping candidate spans, boosted trees on format and context, calibrated thresholds."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared, text_slices, written

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match takes whole runs of digits, so one can only begin where a run does
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# generators of further candidates; every pattern takes time in proportion to the text
AT = re.compile(r"\x20?(?:@|[(\[{]\x20?(?:at|AT|@)\x20?[)\]}])\x20?")
LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\x20?(?:\.|[(\[{]\x20?(?:dot|DOT|\.)\x20?[)\]}])\x20?[A-Za-z0-9-]+)*")
LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]+(?:(?:\x20\.\x20|\.|[(\[](?:\.|dot)[)\]])[0-9]+){3}(?!\.?[0-9])")
NUMBERS = re.compile(r"[(+]?(?<![0-9])[0-9]+(?:[\x20./()-]+[0-9]+)*")
CUES = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server"), "card": ("card", "visa", "pay"), "phone": ("tel", "phone", "call")}
# Digits of card numbers (ISO/IEC 7812, from 12 on in use) and of phone numbers (E.164, from 7 on).
CARD_DIGITS, PHONE_DIGITS = (12, 19), (7, 15)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost, non-overlapping spans of each kind; matches that fail their test are dropped."""
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


def loose_spans(text: str) -> set[tuple[str, int, int]]:
    """High-recall candidates; spans may overlap."""
    found, end = set(), 0
    if "@" in text or "at" in text or "AT" in text:
        for m in AT.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start() and (d := LOOSE_DOMAIN.match(text, m.end())):
                found.add(("email", start, d.end()))
                end = d.end()
    if "." in text or "dot" in text:
        found.update(("ip", m.start(), m.end()) for m in LOOSE_IP.finditer(text))
    for m in NUMBERS.finditer(text):
        if m.end() - m.start() < PHONE_DIGITS[0]:
            continue
        groups = [(g.start(), g.end()) for g in GROUP.finditer(text, m.start(), m.end())]
        if PHONE_DIGITS[0] <= sum(b - a for a, b in groups) <= PHONE_DIGITS[1]:
            found.add(("phone", m.start(), m.end()))
        d = digits_of(m[0])
        if len(d) < CARD_DIGITS[0]:
            continue
        # check sums of all stretches from two running sums, one with every odd digit doubled, one with every even one
        sums = [list(accumulate((DOUBLED[int(c)] if k % 2 == odd else int(c) for k, c in enumerate(d)), initial=0)) for odd in (0, 1)]
        edges = list(accumulate((b - a for a, b in groups), initial=0))
        for i in range(len(groups)):  # runs of groups, of at most as many groups as a card has digits
            for j in range(i + 1, min(len(groups), i + CARD_DIGITS[1]) + 1):
                if edges[j] - edges[i] > CARD_DIGITS[1]:
                    break
                check = sums[edges[j] % 2]
                if edges[j] - edges[i] >= CARD_DIGITS[0] and (check[edges[j]] - check[edges[i]]) % 10 == 0:
                    found.add(("card", groups[i][0], groups[j - 1][1]))
    return found


GROUP = re.compile("[0-9]+")
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)  # digit sums of twice a digit
MARKS = ("@", "at)", "at]", "dot)", "dot]", "[.]", ".", "-", " ", "/", "(", "+")


def describe(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format, check digit and context of a span."""
    span, before, after = text[a:b], text[max(0, a - 24) : a].lower(), text[b : b + 24].lower()
    d = digits_of(span)
    parts = GROUP.findall(span) or [""]
    groups = [len(x) for x in parts]
    cue = [float(any(w in before or w in after for w in CUES[k])) for k in KINDS]
    low = span.lower()
    return [
        *[float(kind == k) for k in KINDS], float(len(span)), float(len(d)), len(d) / len(span), float(len(groups)), float(max(groups)), float(min(groups)), float(groups[0]), float(groups[-1]),
        *[float(low.count(x)) for x in MARKS], float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after), float(before[-1:].isalnum()), float(after[:1].isalnum()),
        float(len(d) > 1 and luhn(d)), float(max((int(x[:6] or 0) for x in parts), default=0) <= 255), float(d[:1] or -1), float(d[:2] == "00"), *cue, float(before.rstrip()[-1:] in (":", ".")),
    ]


def planted(text: str, rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """`text` with one made-up, obfuscated datum of each kind, and their spans: what the base rules miss by construction."""
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(3, 9)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    at, dot = rng.choice((" (at) ", "(at)", " [at] ", "[at]", "{at}", " @ ")), rng.choice((" (dot) ", "(dot)", " [dot] ", "[dot]", "."))
    made = {"email": f"{word()}{rng.choice(('.', '_', ''))}{word()}{at}{word()}{dot}{rng.choice(('com', 'org', 'de', 'net'))}"}
    made["ip"] = rng.choice(("[.]", "(.)", " . ", "[dot]")).join(str(rng.randint(1, 255)) for _ in range(4))
    digits = rng.choice("3456") + number(14)
    digits += next(c for c in "0123456789" if luhn(digits + c))
    made["card"] = rng.choice((".", "/", "  ", " - ")).join(digits[i : i + 4] for i in (0, 4, 8, 12))
    made["phone"] = rng.choice((f"0{number(3)} / {number(7)}", f"0{number(3)}-{number(3)}-{number(4)}", f"({rng.choice('23456789')}{number(2)}) {rng.choice('23456789')}{number(2)}-{number(4)}", f"00{rng.randint(20, 98)} {number(3)} {number(3)} {number(3)}"))
    spans, cuts = [], sorted(rng.choice([m.end() for m in GAP.finditer(text)] or [0]) for _ in KINDS)
    out, at_ = [], 0
    for cut, kind in zip(cuts, rng.sample(KINDS, len(KINDS)), strict=True):
        lead = rng.choice(("", "", rng.choice(CUES[kind]) + " ", rng.choice(CUES[kind]) + ": "))
        out += [text[at_:cut], f" {lead}"]
        start = sum(map(len, out))
        out += [made[kind], " "]
        spans.append((kind, start, start + len(made[kind])))
        at_ = cut
    return "".join([*out, text[at_:]]), spans


GAP = re.compile(r"\s")
STRUCT = "kind: string, start: bigint, end: bigint"
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def example_batches(bound: int):
    """(truth, x) of labelled candidates: planted data, and against them what the generators propose in the texts as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            truth, x = [], []
            for text in part.column("text").to_pylist():
                rng = random.Random(f"plants:{hashlib.sha256((text or '').encode()).hexdigest()}")
                text, plants = planted(text or "", rng)
                base = set(base_spans(text))
                for kind, a, b in sorted(loose_spans(text) - base):
                    near = [p for p in plants if p[1] < b and a < p[2]]
                    hit = (kind, a, b) in near
                    if hit or not near and rng.getrandbits(62) < bound:
                        truth.append(hit)
                        x.append(describe(text, kind, a, b))
            yield pa.RecordBatch.from_arrays([pa.array(truth, pa.bool_()), pa.array(x, pa.list_(pa.float32()))], ["truth", "x"])

    return run


def candidate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    more = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("x", pa.list_(pa.float32()))]))
    for part in text_slices(batches):
        bases, candidates = [], []
        for text in part.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            bases.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in base])
            taken = sorted((a, b) for _, a, b in base)
            starts = [a for a, _ in taken]
            reach = list(accumulate((b for _, b in taken), max))
            free = [c for c in sorted(loose_spans(text)) if not (k := bisect_left(starts, c[2])) or reach[k - 1] <= c[1]]
            candidates.append([{"kind": k, "start": a, "end": b, "x": describe(text, k, a, b)} for k, a, b in free])
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bases, SPANS), pa.array(candidates, more)], ["doc_id", "base", "candidates"])


class BoostedTrees:
    """Gradient boosting of depth-3 trees on quantile bins with the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, rate: float = 0.2, depth: int = 3):
        self.edges = [np.unique(np.quantile(column, np.linspace(0, 1, 33)[1:-1])) for column in x.T]
        self.bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        binned, score = self.bins(x), np.full(len(y), self.bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            tree = self.grow(binned, y - p, p * (1 - p), depth, rate)
            self.trees.append(tree)
            score += self.leaves(tree, binned)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    @staticmethod
    def grow(binned: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int, rate: float):
        feature, split = np.zeros(2**depth - 1, int), np.full(2**depth - 1, 99)
        node = np.zeros(len(binned), int)
        for k in range(2**depth - 1):
            here = node == k
            best = 1e-6
            for f in range(binned.shape[1]):
                g = np.cumsum(np.bincount(binned[here, f], gradient[here], 33))
                h = np.cumsum(np.bincount(binned[here, f], weight[here], 33))
                gain = g**2 / (h + 1) + (g[-1] - g) ** 2 / (h[-1] - h + 1) - g[-1] ** 2 / (h[-1] + 1)
                if gain.max() > best:
                    best, feature[k], split[k] = gain.max(), f, int(gain.argmax())
            node[here] = 2 * k + 1 + (binned[here, feature[k]] > split[k])
        leaf = node - (2**depth - 1)
        values = rate * np.bincount(leaf, gradient, 2**depth) / (np.bincount(leaf, weight, 2**depth) + 1)
        return feature, split, values

    @staticmethod
    def leaves(tree, binned: np.ndarray) -> np.ndarray:
        feature, split, values = tree
        node = np.zeros(len(binned), int)
        for _ in range(int(np.log2(len(values)))):
            node = 2 * node + 1 + (binned[np.arange(len(binned)), feature[node]] > split[node])
        return values[node - len(feature)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        binned = self.bins(x)
        return 1 / (1 + np.exp(-(self.bias + sum(self.leaves(t, binned) for t in self.trees))))


def thresholds(kind: np.ndarray, p: np.ndarray, truth: np.ndarray, recall: float) -> dict[str, float]:
    """Per kind a probability that `recall` of the held-out plants reach, halfway to the likeliest other candidate below; 0.5 at least.

    Precision can't be the measure: some of the other candidates are personal data that nobody labelled.
    """
    out = {}
    for k, name in enumerate(KINDS):
        good, other = p[(kind == k) & truth], p[(kind == k) & ~truth]
        if not len(good):
            out[name] = 2.0
            continue
        reached = float(np.quantile(good, 1 - recall, method="lower"))
        out[name] = max(0.5, (reached + max(other[other < reached], default=0.0)) / 2)
    return out


def fit(sample: list, recall: float) -> tuple[BoostedTrees, dict[str, float]] | None:
    """Trees on two thirds of a labelled sample, thresholds on the rest."""
    if len(sample) < 30 or len({r["truth"] for r in sample}) < 2:
        return None
    x, y = np.array([r["x"] for r in sample], float), np.array([r["truth"] for r in sample], float)
    held = np.arange(len(y)) % 3 == 0
    trees = BoostedTrees(x[~held], y[~held])
    return trees, thresholds(x[held, :4].argmax(axis=1), trees.probability(x[held]), y[held] > 0, recall)


def choose_batches(model):
    """Base spans, and what the trees add where it overlaps no likelier addition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            candidates = part.column("candidates").to_pylist()
            every = [(k, c) for k, some in enumerate(candidates) for c in some]
            added: list[list[dict]] = [[] for _ in candidates]
            if model.value and every:
                trees, least = model.value
                p = trees.probability(np.array([c["x"] for _, c in every], float))
                taken: list[list[tuple[int, int]]] = [[] for _ in candidates]  # sorted, separate
                for i in np.lexsort(([c["start"] for _, c in every], -p)).tolist():
                    k, c = every[i]
                    if p[i] >= least[c["kind"]]:
                        at = bisect_left(taken[k], (c["start"], c["end"]))
                        if (not at or taken[k][at - 1][1] <= c["start"]) and (at == len(taken[k]) or c["end"] <= taken[k][at][0]):
                            taken[k].insert(at, (c["start"], c["end"]))
                            added[k].append({"kind": f"likely_{c['kind']}", "start": c["start"], "end": c["end"]})
            added = [sorted(x, key=lambda s: (KINDS.index(s["kind"][7:]), s["start"])) for x in added]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("base"), pa.array(added, SPANS)], ["doc_id", "base", "added"])

    return run


def find_pii(docs: DataFrame, sample_rows: int = 20_000, recall: float = 0.97) -> DataFrame:
    """(doc_id, base, added): spans in code points for every row of `docs`.

    The trees learn from made-up data in obfuscated forms, which the base rules miss, planted in a sample
    of the texts by hash: those are the positive labels, and what the generators propose elsewhere in the
    sample the negative ones. Of both some `sample_rows` at most are expected, as the sample is of different
    texts; the draw depends on the texts alone, so every run has the same. All candidates of all texts are scored. Thresholds by kind keep
    `recall` of held-out plants. NULL and empty texts have no spans; repeated rows are judged each;
    too few labels to fit: base spans only. An empty table gives an empty result. Other columns are
    ignored. A text of any length is taken whole.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = written(docs.select("doc_id", "text").mapInArrow(candidate_batches, f"doc_id {kind}, base array<struct<{STRUCT}>>, candidates array<struct<{STRUCT}, x: array<float>>>"), "candidates")
    rows, proposed = found.agg(F.count("*"), F.coalesce(F.sum(F.size("candidates")), F.lit(0))).first()
    half = sample_rows // 2
    share = min(1.0, half / max(1, rows * len(KINDS)))
    drawn = docs.select("text").where(F.abs(F.xxhash64("text", F.lit("plants")) % 1_000_000_007) < int(1_000_000_007 * share) + (share == 1))
    chosen = drawn.dropDuplicates(["text"])  # copies are drawn together, and would all be labelled
    bound = int(min(1.0, half / max(1, proposed * share)) * (1 << 62))
    labelled = chosen.mapInArrow(example_batches(bound), "truth boolean, x array<float>").collect()
    labelled.sort(key=lambda r: (r["x"], r["truth"]))
    model = shared(docs.sparkSession, fit([labelled[i] for i in np.random.default_rng(5).permutation(len(labelled))], recall))
    return found.mapInArrow(choose_batches(model), f"doc_id {kind}, base array<struct<{STRUCT}>>, added array<struct<{STRUCT}>>")


def pii_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_found for every row."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    found = find_pii(docs, **how)
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    added = F.size("added").cast("long")
    return found.select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in KINDS], F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans"), added.alias("n_added"), (F.size("base") + added).alias("n_found")
    )
