"""The text operators against brute force, on awkward rows and on the small tables."""

import hashlib
import random
import re
import subprocess
import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from paddock.llm import common, components, decontam, licenses, linededup, lmscore, mixing, pii, quality, queries, secrets, simhash, suffixdedup

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(common.UPPER, common.LOWER)
LONG = " ".join(f"wort{k % 977} ähnlich{k % 13}" for k in range(30_000))
PROSE = "the quick brown fox jumps over the lazy dog while seven other animals look on from the hill and wonder why"
ROWS = [
    (1, PROSE, "a", 1), (2, PROSE, "a", 1), (2, PROSE, "a", 1), (3, None, None, None), (4, "", "b", 0), (5, " \n\t ", "b", 4), (6, LONG, None, 1), (None, PROSE.upper(), "c", 2),
    (7, PROSE + "\n" + PROSE + "\nshort\nshort", "b", 3), (8, PROSE.replace("seven", "eight"), "é", 3), (9, "password: 'abcdef1' token=ab AKIA" + "A1" * 10 + " " + "0a" * 13, "b", 1),
]
OPERATORS = {
    "simhash": lambda d, b: simhash.simhash_components(d), "license": lambda d, b: licenses.license_scan(d), "lm": lambda d, b: lmscore.pseudo_likelihood(d), "suffix": lambda d, b: suffixdedup.dedup_substrings(d),
    "mix": lambda d, b: mixing.mix_sources(d), "lines": lambda d, b: linededup.report(d), "secrets": lambda d, b: secrets.secret_report(d), "pii": lambda d, b: pii.pii_report(d),
    "quality": lambda d, b: quality.quality_verdicts(d), "decontam": lambda d, b: decontam.verdicts(d, b),
}
STAGES = {
    "keep_good": lambda d, b: quality.keep_good(d), "drop_lines": lambda d, b: linededup.drop_lines(d), "keep_one": lambda d, b: simhash.keep_one(d), "remove_hits": lambda d, b: decontam.remove_hits(d, b),
    "mix": lambda d, b: mixing.mix_sources(d, with_documents=True),
}


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, n_chars long")
    return df.withColumns({"fp": F.lit(1), "line": F.lit("x"), "tid": F.lit(2), "n_words": F.lit("y"), "key": F.lit(3), "size": F.lit(4), "kept_id": F.lit(5), "of": F.lit(6)})


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PROSE), (2, None), (3, "..."), (4, "lazy dog"), (4, "lazy dog"), (None, "look on")], "item_id long, text string")


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents")


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(awkward, bench, name):
    rows = OPERATORS[name](awkward, bench).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(awkward, bench, name):
    assert OPERATORS[name](awkward.limit(0), bench.limit(0)).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_awkward_rows(awkward, bench, name):
    out = STAGES[name](awkward, bench)
    assert name == "mix" or out.columns == awkward.columns
    assert out.count() <= len(ROWS)
    assert STAGES[name](awkward.limit(0), bench).count() == 0


def test_fingerprints(docs):
    got = {r.doc_id: r.fp for r in simhash.fingerprints(docs).collect()}
    for r in docs.collect():
        w = [x.decode() for x in (r.text or "").translate(LOWER).encode().split()]
        grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[r.doc_id] % 2**64 == want


@pytest.mark.parametrize("how", [{}, {"segments": 8}, {"tile_rows": 3}])
def test_simhash_components(docs, how):
    rows = simhash.simhash_components(docs, **how).collect()
    want = simhash.brute_force({r.doc_id: int(r.fingerprint, 16) for r in rows})
    assert {r.doc_id: r.component_id for r in rows} == want


def test_tiles_find_all_close_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 63, 60, dtype=np.uint64)) for _ in range(3)]]))
    df = spark.createDataFrame([(int(x),) for x in fps.astype(np.int64)], "fp long")
    comp = {r.node: r.component for r in components.components(simhash.near_links(df, tile_rows=4)).collect()}
    want = simhash.brute_force({int(x): int(x) for x in fps})
    assert all(comp.get(k, k) == v for k, v in want.items())


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(50, 51), (52, 51), (60, 60), (51, 50)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {50: 50, 51: 50, 52: 50}


@pytest.mark.parametrize("how", [{}, {"most_bits": 1 << 12}, {"hot": 2, "shard": 5}, {"hot": 0}])
def test_suffix_dedup(spark, how):
    rng = np.random.default_rng(1)
    pieces = ["".join(rng.choice(list("abcdé "), 70)) for _ in range(12)]
    texts = {k: "".join(pieces[i] for i in rng.integers(0, 12, rng.integers(0, 8))) for k in range(60)} | {99: "z" * 500, 100: "z" * 450 + "y", 101: "short"}
    want = suffixdedup.brute_force({k: t.encode() for k, t in texts.items()}, 100)
    rows = suffixdedup.dedup_substrings(spark.createDataFrame([*texts.items(), *texts.items()], "doc_id long, text string"), **how).collect()
    assert len(rows) == 2 * len(texts)
    assert {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want


@pytest.mark.parametrize("rows", [1 << 20, 37, 4, 1])
def test_transform_is_sorted(tmp_path, rows):
    """Whatever the blocks in which the columns are read."""
    rng = np.random.default_rng(5)
    strings = [bytes(rng.integers(97, 100, rng.integers(1, 30)).astype(np.uint8)) for _ in range(50)]
    bwt = suffixdedup.CollectionBWT(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), str(tmp_path), rows)
    suffix, lcp = bwt.whole("suffix").astype(int), bwt.whole("lcp")
    found = [(strings[s >> bwt.bits][len(strings[s >> bwt.bits]) - (s & ((1 << bwt.bits) - 1)) :], s >> bwt.bits) for s in suffix]
    assert found == sorted(found)
    common_prefix = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert [common_prefix(a[0], b[0]) for a, b in zip(found, found[1:], strict=False)] == lcp[1:].tolist()


def test_suffix_dedup_of_the_table(docs):
    want = suffixdedup.brute_force({r.doc_id: (r.text or "").encode() for r in docs.collect()}, 100)
    rows = suffixdedup.dedup_substrings(docs).collect()
    assert {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want and sum(r.n_removed > 0 for r in rows) > 10


@pytest.mark.parametrize("length", [8, 300])
def test_suffix_dedup_of_other_lengths(spark, length, monkeypatch):
    """Lengths well over a byte's range, and texts taken in pieces."""
    rng = np.random.default_rng(9)
    piece = "".join(rng.choice(list("abcdefgh "), 400))
    texts = {1: "x" * 700 + piece, 2: piece[:350] + "q", 3: "".join(rng.choice(list("abc"), 900)), 4: "y" + piece}
    want = suffixdedup.brute_force({k: t.encode() for k, t in texts.items()}, length)
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    assert {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.dedup_substrings(df, length).collect()} == want
    whole = [x for data, offsets, base, _ in suffixdedup.pieces(pa.array([piece]), 30) for x in base + suffixdedup.anchors(data, offsets, 30)[1] - offsets[0]]
    monkeypatch.setattr(suffixdedup, "PIECE", 64)
    parts, covered = [], 0
    for data, offsets, base, _ in suffixdedup.pieces(pa.array([piece]), 30):
        found = suffixdedup.anchors(data, offsets, 30)
        parts += (base + found[1]).tolist()
        covered += int(found[2].sum())
    assert set(whole) <= set(parts) and covered == len(piece) - 29


def test_decontamination(spark, docs):
    benchmark = common.table(spark, SF, "benchmark")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate(LOWER))
    phrase = {}
    for r in benchmark.collect():
        w = cut(r.text)
        for i in range(max(1, len(w) - 9)):
            phrase.setdefault(tuple(w[i : i + 10]), set()).add(str(r.item_id))
    got, n = {r.doc_id: r for r in decontam.verdicts(docs, benchmark).collect()}, 0
    for r in docs.collect():
        w, hit, items = cut(r.text), set(), set()
        for size in {len(p) for p in phrase}:
            for i in range(len(w) - size + 1):
                if (p := tuple(w[i : i + size])) in phrase:
                    hit |= set(range(i, i + size))
                    items |= phrase[p]
        n += bool(hit)
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) == (len(w), len(hit), len(items), decontam.sha_of_items(list(items)), bool(hit))
    clean = decontam.verdicts(decontam.remove_hits(docs, benchmark), benchmark)
    assert n and clean.where("contaminated").count() == 0


def test_benchmark_blocks(awkward, bench):
    whole = decontam.verdicts(awkward, bench).collect()
    blocks = decontam.contamination(awkward.select("doc_id", "text"), bench, block_bytes=8).collect()
    assert sorted((str(r.doc_id), r.n_hit) for r in blocks) == sorted((str(r.doc_id), r.n_hit) for r in whole)


def test_index(spark):
    rng = np.random.default_rng(2)
    seq = rng.integers(1, 5, 300)
    index = decontam.FMIndex(seq, 5)
    for size in (1, 2, 4):
        pattern = np.array([list(p) for p in {tuple(seq[i : i + size]) for i in range(290)}], np.int32)
        low, high = index.search(pattern, np.full(len(pattern), size))
        for p, a, b in zip(pattern, low, high, strict=True):
            want = [i for i in range(len(seq) - size + 1) if (seq[i : i + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("chunk", [1024, 2])
def test_lines(spark, chunk):
    near = PROSE.replace("hill", "mill")
    df = spark.createDataFrame([(3, f"{near}\nfresh line of its own\n\n"), (1, f"{PROSE}\nfirst"), (2, f"first\n{PROSE.upper()}\n{PROSE} again"), (4, "fresh  other text altogether")], "doc_id long, text string")
    rows = {r.doc_id: r.removed for r in linededup.report(df, chunk=chunk).collect()}
    assert rows == {1: [], 2: [0, 1, 2], 3: [0], 4: []}
    kept = {r.doc_id: r.text for r in linededup.drop_lines(df, chunk=chunk).collect()}
    assert kept == {1: f"{PROSE}\nfirst", 3: "fresh line of its own\n\n", 4: "fresh  other text altogether"}


def test_line_recall(docs):
    verdict = {(r.doc_id, r.line_no): r.component for r in linededup.line_verdicts(docs).collect()}
    text = "äbcdéfgh abc日本語の abcdefgh"
    assert linededup.shingles(text.encode()) == {text[i : i + 8] for i in range(len(text) - 7)}
    assert len(linededup.hashed_shingles(text.encode())) == len(linededup.shingles(text.encode()))
    assert set(linededup.hashed_shingles(b"abcdefgh")) < set(linededup.hashed_shingles(text.encode()))
    lines = {(d.doc_id, k): line.translate(LOWER).encode() for d in docs.collect() for k, line in enumerate((d.text or "").split("\n")) if line.encode().split()}
    assert set(verdict) == set(lines)
    first, bags = {}, {}
    for k, v in lines.items():
        first.setdefault(v, k)
        bags.setdefault(v, linededup.shingles(v))
    by_size = sorted(bags, key=lambda v: len(bags[v]))
    close = found = 0
    for i, a in enumerate(by_size):
        for b in by_size[i + 1 :]:
            if len(bags[b]) * 0.8 > len(bags[a]):
                break
            both = len(bags[a] & bags[b])
            if both >= 0.8 * (len(bags[a]) + len(bags[b]) - both):
                close += 1
                found += verdict[first[a]] == verdict[first[b]]
    assert found >= 0.9 * close


def test_rows_that_share_a_doc_id(spark):
    """They lose only their own lines, and each is judged by its own text."""
    df = spark.createDataFrame([(1, "shared line number one here"), (2, "shared line number one here"), (2, "a wholly different unique passage")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in linededup.drop_lines(df).collect()) == [(1, "shared line number one here"), (2, "a wholly different unique passage")]
    good = " ".join(f"{w}{k}." for k, w in enumerate(PROSE.split() * 3))
    kept = quality.keep_good(spark.createDataFrame([(1, good), (1, "bad"), (None, good), (None, None)], "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "None"] and {r.text for r in kept} == {good}


def test_clashing_names_in_any_case(spark, bench):
    df = spark.createDataFrame([(1, PROSE + " and more words of its own", "a", 5, 6, 7)], "doc_id long, text string, source string, N_Words long, Size long, Hit long")
    cut = decontam.remove_hits(df, bench)
    assert cut.columns == df.columns and cut.first().N_Words == 5 and PROSE not in cut.first().text
    mixed = mixing.mix_sources(df, with_documents=True)
    assert mixed.columns == [*df.columns, "size_", "source_size", "target", "taken"]
    assert common.written(mixed, "mixed").first().Size == 6
    assert quality.keep_good(df).columns == df.columns


def test_large_bucket(spark):
    """A bucket of many variants of a template, and others that share it but not the similarity."""
    variants = [f"{PROSE} number {k:03d} of the whole long list of lines that differ by a number only" for k in range(40)]
    df = spark.createDataFrame(list(enumerate(variants)), "doc_id long, text string")
    whole = {r.doc_id: r.removed for r in linededup.report(df).collect()}
    assert whole == {0: []} | {k: [0] for k in range(1, 40)}
    assert {r.doc_id: r.removed for r in linededup.report(df, chunk=3).collect()} == whole


@pytest.mark.parametrize("kind", ["word", "lines", "words"])
def test_texts_over_many_blocks(kind):
    """Counts and hashes of a text of several blocks are those of its parts put together."""
    text = {"word": "ab" * 500_000, "lines": "one line of text, again\n" * 40_000 + "end", "words": " ".join(f"w{k}" for k in range(150_000))}[kind]
    data = np.frombuffer(text.encode(), np.uint8)
    places = np.array([0, 5, common.BLOCK - 1, common.BLOCK, common.BLOCK + 3, len(data) - 30])
    short = [common.RangeHash(data[a : a + 30])(np.zeros(1, int), np.array([30]))[0] for a in places]
    assert common.RangeHash(data)(places, places + 30).tolist() == short
    assert len({common.RangeHash(data[a:])(np.zeros(1, int), np.array([len(data) - a]))[0] for a in (0, 0)}) == 1
    counts = dict(zip(quality.COUNTS, (int(x[0]) for x in quality.counts_of(pa.array([text]))), strict=True))
    lines = text.split("\n")
    assert counts["n_words"] == len(text.split()) and counts["n_dup_lines"] == len(lines) - len(set(lines)) and counts["word_chars"] == sum(map(len, text.split()))
    starts, ends, _, _ = linededup.line_spans(data, np.array([0, len(data)]))
    got = [(int(k), int(h)) for lines_, hashes in linededup.shingle_blocks(data, starts, ends) for k, h in zip(lines_, hashes, strict=True)]
    assert len(got) == sum(max(0, len(x) - 7) for x in lines)
    assert len({h for _, h in got}) == len({x[i : i + 8] for x in lines for i in range(len(x) - 7)})


def test_memory_of_a_long_text():
    """A text of 50 MB is counted in a bounded multiple of its size."""
    code = (
        "import resource, pyarrow as pa; from paddock.llm import quality; quality.counts_of(pa.array(['a b'])); before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss;"
        "t = pa.array(['seven words are in this line here\\n' * 1_500_000]); quality.counts_of(t); print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    )
    used = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout)
    assert used < 900


def test_scratch_removes_tables(spark):
    with common.scratch(spark):
        path = common.written(spark.range(3).toDF("x"), "t").inputFiles()[0].removeprefix("file://")
        assert Path(path).exists()
    assert not Path(path).exists()


def base_secrets(text):
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(secrets.ASSIGN, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_secrets(spark, docs):
    odd = ["😀 secret:token:abcdefg", "token=secret=abcdef PASSWORD : \"xyz123_/\"", "AKIA12AKIA" + "B" * 20, "ghp_" + "a1B2" * 9, "api-key=aaaaaaaa apikey=aaaaaaaa", "f" * 60, None]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-k - 1, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    got = {r.doc_id: r for r in secrets.secret_report(df).collect()}
    for r in df.collect():
        assert got[r.doc_id].base_sha256 == hashlib.sha256(base_secrets(r.text or "").encode()).hexdigest()
    assert "github:0:40" in got[-4].spans
    began = time.time()
    runs = spark.createDataFrame([(1, "a" * 1_000_000), (2, "x" * 300_000 + " ftp://me:pw@host " + "eyJ" * 200_000)], "doc_id long, text string")
    assert [r.spans for r in secrets.secret_report(runs).orderBy("doc_id").collect()] == ["hex:0:1000000", "url_login:300001:300013"]
    assert time.time() - began < 60  # the pattern alone takes milliseconds; the rest is Spark
    assert secrets.trigram_query(secrets.RULES[2].regex) == []


BASE_PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(pii.digits_of(m)) <= 19 and pii.luhn(pii.digits_of(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(pii.digits_of(m)) <= 15),
]


def test_pii(spark, docs):
    odd = ["a@b.c_d@e.f@g.h", "x@y @z.w q@r.", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.255", "4111 1111-1111 1111 4111 1111 1111 1112", "+1 (523) 555-1055 + +12", None, "9" * 5000]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-k - 1, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    got = {r.doc_id: r for r in pii.pii_report(df).collect()}
    for r in df.collect():
        want = ",".join(f"{k}:{m.start()}:{m.end()}" for k, regex, good in BASE_PII for m in re.finditer(regex, r.text or "") if good(m[0]))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_pii_finds_obfuscated_data(spark, docs):
    """Plants of another draw than those the trees learn from, in every eighth text: nearly all are added, and little else is."""
    rng, rows, plants = random.Random(11), [], {}
    for r in docs.collect():
        text, plants[r.doc_id] = pii.planted(r.text or "", rng) if r.doc_id % 8 == 0 else (r.text, [])
        rows.append((r.doc_id, text))
    got = {r.doc_id: r.added for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = dict.fromkeys(pii.KINDS, 0)
    for d, some in plants.items():
        for kind, a, b in some:
            hit[kind] += any(s.kind == f"likely_{kind}" and s.start < b and a < s.end for s in got[d])
    assert sum(hit.values()) >= 0.9 * sum(map(len, plants.values())) and min(hit.values()) > 0.8 * sum(map(bool, plants.values())), hit
    extra = sum(not any(a < s.end and s.start < b for _, a, b in plants[d]) for d, some in got.items() for s in some)
    assert extra <= 0.1 * len(plants), extra


def test_pii_long_runs(spark):
    """Time grows in proportion to a run; card candidates are the windows that pass the check digit."""
    digits = "4111 1111 1111 1111 5500 0000 0000 0004 12 7"
    groups = [m.span() for m in re.finditer("[0-9]+", digits)]
    want = {(a, d) for i, (a, _) in enumerate(groups) for _, d in groups[i:] if 12 <= len(x := pii.digits_of(digits[a:d])) <= 19 and pii.luhn(x)}
    assert {(a, b) for k, a, b in pii.loose_spans(digits) if k == "card"} == want
    began = time.time()
    for text in ("9" * 300_000, "1 " * 200_000, "a" * 500_000 + "@", "1.2.3." * 100_000, "x (at) " * 50_000):
        pii.loose_spans(text)
        pii.base_spans(text)
    assert time.time() - began < 20


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5)).astype(float)
    trees = pii.BoostedTrees(x[:1500], y[:1500])
    assert ((trees.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def test_quality(spark, docs):
    got = {r.doc_id: r for r in quality.quality_verdicts(docs).collect()}
    for r in docs.collect():
        text = r.text or ""
        w = [x.decode() for x in text.encode().split()]
        lines, seen, dup = text.split("\n"), set(), 0
        for line in lines:
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        where = {}
        for i in range(len(w) - 7):
            where.setdefault(tuple(w[i : i + 8]), []).append(i)
        again = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(8)}
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(again))
        assert g.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w))
    labels = {r.doc_id: r.quality for r in common.table(spark, SF, "labels").collect()}
    good = [got[d].kept for d, q in labels.items() if q == 1 and not got[d].base_failed]
    assert sum(good) >= 0.95 * len(good)


def test_accuracies():
    rng = np.random.default_rng(4)
    truth, accuracy = rng.random(20000) < 0.7, np.array([0.95, 0.8, 0.7])
    votes = np.where(rng.random((20000, 3)) < accuracy, truth[:, None], ~truth[:, None])
    patterns = {}
    for v in votes:
        key = "".join("2" if x else "0" for x in v)
        patterns[key] = patterns.get(key, 0) + 1
    found, prior = quality.fit_accuracies(patterns, 300)
    assert np.abs(found - accuracy).max() < 0.08
    assert abs(prior - 0.7) < 0.05


def test_mix_totals(docs):
    rows = mixing.mix_sources(docs).collect()
    by = {}
    for r in rows:
        t = by.setdefault((r.source_size, r.target), [0, 0])
        t[0] += r.taken
        t[1] = max(t[1], r["size"])
        assert r.taken <= 3 * r["size"]
    assert all(abs(taken - target) <= most for (_, target), (taken, most) in by.items())


def test_lm_prefers_real_order(spark, docs):
    vocabulary = lmscore.vocabulary_of(docs)
    flat = lmscore.train(docs, vocabulary, rate=2, rounds=6, workers=2)
    held, start = lmscore.Network(flat), lmscore.Network.start(vocabulary.log_class)
    start.parts[2][:] = 0
    better = []
    for r in docs.limit(40).toArrow().to_batches():
        found, cuts = lmscore.buckets(r)
        classes = vocabulary.class_of[found]
        near = lmscore.windows(classes, cuts)
        better.append((held.log_probability(near, classes).mean(), start.log_probability(near, classes).mean()))
    assert all(a > b for a, b in better)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(map(str, df.select(names).collect())) == sorted("Row(" + ", ".join(f"{n}={v!r}" for n, v in zip(names, row, strict=True)) + ")" for row in found.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "taken"} <= set(out.columns)
    assert 0 < out.count() <= 200
