"""Secret scans with a trigram inverted index; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if `group` of it has `least` characters; else it is dropped and not tried again."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    base: bool = False


ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # maximal runs, so that a least length inside the regex drops the same matches as one after it
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url_login", r"(?<![a-z])[a-z]+://[^\x00-\x20:@/]+:[^\x00-\x20:@/]+@", 0, 8),
)
MOST = 64  # strings followed at once while a regex is taken apart


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """A Boolean query that every text with a match satisfies, trigrams in lower case.

    All clauses must hold; a clause holds if all trigrams of one of its sets occur. No clause: the regex
    has no mandatory trigram.
    """
    clauses: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        if strings and min(map(len, strings)) >= 3:
            clauses.append(sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}, key=sorted))

    def exact(nodes) -> set[str] | None:
        """All strings that the nodes match, if they are few."""
        found = {""}
        for kind, value in nodes:
            if kind is op.LITERAL:
                part = {chr(value).lower()}
            elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
                part = {chr(c).lower() for _, c in value}
            elif kind is op.SUBPATTERN:
                part = exact(value[-1])
            elif kind is op.BRANCH:
                parts = [exact(x) for x in value[1]]
                part = None if None in parts else set().union(*parts)
            elif kind is op.MAX_REPEAT and value[1] <= 3:
                once = exact(value[2])
                part = None if once is None else {"".join(x) for n in range(value[0], value[1] + 1) for x in product(once, repeat=n)}
            else:
                part = None
            if part is None or len(found) * len(part) > MOST:
                return None
            found = {a + b for a in found for b in part}
        return found

    def walk(nodes) -> None:
        open_ = {""}
        for node in nodes:
            part = exact([node])
            if part is not None and len(open_) * len(part) <= MOST:
                open_ = {a + b for a in open_ for b in part}
                continue
            close(open_)
            open_ = {""}
            kind, value = node
            if kind is op.SUBPATTERN:
                walk(value[-1])
            elif kind is op.MAX_REPEAT and value[0] >= 1:
                walk(value[2])
        close(open_)

    walk(parser.parse(regex))
    return clauses


def found_spans(text: Column, rule: Rule, chunk: int = 512) -> Column:
    """array<struct<start, end>> in code points of the rule's leftmost, non-overlapping matches.

    Matches are placed within chunks of `chunk`, and chunks by their lengths, so the time is in proportion to the
    matches of a text: a fold that appends to an array copies a chunk at most.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), F.split(text, rule.regex, -1)
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def add(state: Column, pair: Column) -> Column:
        begin = state["at"] + pair["gap"]
        end = begin + pair["hit"]
        return F.struct(end.alias("at"), F.when(pair["counted"] >= rule.least, F.array_append(state["out"], F.struct(begin.alias("start"), end.alias("end")))).otherwise(state["out"]).alias("out"))

    def sizes(hit: Column, gap: Column) -> Column:
        counted = F.length(F.regexp_extract(hit, rule.regex, rule.group) if rule.group else hit)
        return F.struct(F.length(hit).cast("long").alias("hit"), F.length(gap).cast("long").alias("gap"), counted.alias("counted"))

    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), sizes)
    cut = lambda all_: F.transform(F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(chunk)), lambda i: F.slice(all_, i, F.lit(chunk)))
    placed = lambda all_: F.transform(cut(all_), lambda part: F.aggregate(part, start, add))

    def shifted(parts: Column) -> Column:
        first = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("starts"))
        starts = F.aggregate(parts, first, lambda s, p: F.struct((s["at"] + p["at"]).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts")))["starts"]
        return F.flatten(F.zip_with(parts, starts, lambda p, at: F.transform(p["out"], lambda x: F.struct((x["start"] + at).alias("start"), (x["end"] + at).alias("end")))))

    # `transform` over an array of one element names a value, which a lambda's body may then use several times
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    return once(pairs, lambda all_: once(placed(all_), shifted))


def kinded(spans: Column, place: int, rule: Rule) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")))


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id, tid): the inverted index of the given trigrams over lower-cased texts."""
    low = lower_ascii(F.col("text"))
    held = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    return texts.withColumn("low", low).select("doc_id", "tid", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[int, list[list[frozenset[str]]]]) -> DataFrame:
    """(doc_id, tid, places): the rules whose Boolean queries the postings satisfy."""
    rows = [(t, place, c, a, len(some)) for place, query in queries.items() for c, clause in enumerate(query) for a, some in enumerate(clause) for t in some]
    asked = index.sparkSession.createDataFrame(rows, "trigram string, place int, clause int, alternative int, need int")
    met = index.join(F.broadcast(asked), "trigram").groupBy("doc_id", "tid", "place", "clause", "alternative").agg(F.countDistinct("trigram").alias("n"), F.first("need").alias("need"))
    held = met.where("n = need").groupBy("doc_id", "tid", "place").agg(F.countDistinct("clause").alias("n"))
    wanted = F.element_at(F.create_map(*[F.lit(x) for p, q in queries.items() for x in (p, len(q))]), F.col("place"))
    return held.where(F.col("n") == wanted).groupBy("doc_id", "tid").agg(F.collect_set("place").alias("places"))


def key_bits(keys: DataFrame, most_bits: int = 1 << 23) -> DataFrame:
    """One row with a bit array over the bigint column of `keys`: 16 bits a key, `most_bits` (1 MB) at most.

    A prefilter before an exact join, so too many keys only let more rows through.
    """
    (name,) = keys.columns
    bits = min(most_bits, 1 << max(10, (16 * max(1, keys.count()) - 1).bit_length()))
    at = F.pmod(F.xxhash64(name), F.lit(bits))
    some = keys.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64({name}), {bits}L) & 63 as int))")).alias("b"))
    every = keys.sparkSession.range(bits >> 6).select(F.col("id").alias("w")).join(some, "w", "left").select("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return written(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("held")).withColumn("bits", F.lit(bits).cast("long")), "bits")


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, tid, found): every row with the sorted spans (start, place, end, kind) of all rules.

    Rules with mandatory trigrams are verified in the candidates that intersected postings name; the
    rest scan every text. NULL is the empty text. Rows equal in doc_id and text get equal results, a NULL
    doc_id is a value like another, and an empty table gives an empty result. Other columns are ignored.
    Every rule takes time in proportion to a text of any length.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.regex))}
    rest = [k for k in range(len(rules)) if k not in queries]
    none = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>")
    scanned = texts.select("doc_id", "tid", F.concat(none, *[kinded(found_spans(F.col("text"), rules[k]), k, rules[k]) for k in rest]).alias("scanned"))
    if not queries:
        return scanned.withColumnRenamed("scanned", "found")
    index = written(postings(texts, sorted({t for q in queries.values() for c in q for some in c for t in some})), "postings")
    named = written(candidates(index, queries).select(F.col("doc_id").alias("of"), F.col("tid").alias("of_tid"), "places"), "candidates")
    # only texts that may be candidates are exchanged to meet them
    held = key_bits(named.select(F.xxhash64("of", "of_tid").alias("k")))
    at = F.pmod(F.xxhash64(F.xxhash64("doc_id", "tid")), F.col("bits"))
    bit = F.getbit(F.element_at("held", (F.shiftright(at, 6) + 1).cast("int")), at.bitwiseAND(63).cast("int"))
    near = texts.join(F.broadcast(held), bit == 1, "left_semi").join(named, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tid") == F.col("of_tid")))
    checked = F.concat(none, *[F.when(F.array_contains("places", k), kinded(found_spans(F.col("text"), rules[k]), k, rules[k])).otherwise(none) for k in queries])
    verified = written(near.select("of", "of_tid", checked.alias("verified")).where(F.size("verified") > 0).dropDuplicates(["of", "of_tid"]), "verified")
    both = scanned.join(verified, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tid") == F.col("of_tid")), "left")
    return both.select("doc_id", "tid", F.array_sort(F.concat("scanned", F.coalesce("verified", none))).alias("found"))


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda place: F.size(F.filter("found", lambda s: s["place"] == place)).cast("long")
    base = [k for k, r in enumerate(rules) if r.base]
    return secret_spans(docs, rules).select(
        "doc_id", *[of(k).alias(f"n_{rules[k].kind}") for k in base],
        F.sha2(text(F.filter("found", lambda s: s["place"].isin(base))), 256).alias("base_sha256"), text(F.col("found")).alias("spans"),
    )
