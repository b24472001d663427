"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, any_names, partitions, unused, written

BITS, LEVELS = 12, 5


def placed(sources: DataFrame) -> DataFrame:
    """`sources` with `place`, from 0, in code-point order of source, NULL last: ranks within ranges plus what lies before each range."""
    ranges = sources.repartitionByRange(partitions(sources.sparkSession), F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    ranges = written(ranges, "ranges")
    counts, before, rows = {r[0]: r[1] for r in ranges.groupBy("range").count().collect()}, 0, []
    for k in sorted(counts):
        rows.append((k, before))
        before += counts[k]
    offsets = F.broadcast(sources.sparkSession.createDataFrame(rows, "range int, before long"))  # one row a shuffle partition
    within = Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())
    return ranges.join(offsets, "range").withColumn("place", F.col("before") + F.row_number().over(within) - 1).drop("range", "before")


def shares(sources: DataFrame, most: int = 3) -> DataFrame:
    """(key, source, source_size) -> with `target`: the whole divided by weights 1, 2, 3, repeating in code-point order.

    A target stops at `most` times its source. All uncapped sources share one level by weight; it rises
    with every excess reshared, until it caps no further source. Each step is one aggregate over the
    sources, whose number is unbounded, so none passes through a single task.
    """
    ranked = written(placed(sources).withColumn("weight", F.col("place") % 3 + 1).withColumn("cap", most * F.col("source_size")), "ranked")
    total, weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, seen = (total / weights if weights else 0.0), -1
    while True:
        capped = F.col("cap") <= F.lit(level) * F.col("weight")
        n, caps, free = ranked.agg(F.count_if(capped), F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if n == seen or not free:
            break
        seen, level = n, (total - (caps or 0)) / free
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")) if weights else F.lit(0.0)
    if weights and not free:
        target = F.col("cap").cast("double")
    return ranked.select("key", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(key, hash, size), (key, extra) -> (key, threshold): rows with hash below it hold about `extra` words.

    Each level sums words by source and the next BITS of the hash among rows of the boundary bucket
    found before, so only that bucket is looked at again. A row is in when the middle of its words lies
    within the budget. No boundary: everything is in.
    """
    bounds, done = budgets.select("key", F.lit(0).cast("long").alias("prefix"), F.col("extra").alias("left")), []
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = sized.join(bounds, "key").where(F.shiftright("hash", shift + BITS) == F.col("prefix"))
        sums = inside.groupBy("key", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.first("left").alias("left"))
        upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        over = sums.withColumn("upto", F.sum("size").over(upto)).where(F.col("upto") > F.col("left"))
        first = over.groupBy("key").agg(F.min_by(F.struct("bucket", "size", "upto", "left"), "bucket").alias("b")).select("key", "b.*")
        found = written(first.select("key", F.col("bucket").alias("prefix"), (F.col("left") - F.col("upto") + F.col("size")).alias("left"), "size"), "bounds")
        if level == LEVELS:
            done.append(found.select("key", (F.col("prefix") + (F.col("size") <= 2 * F.col("left")).cast("long")).alias("threshold")))
        bounds = found.drop("size")
    return reduce(DataFrame.unionByName, done)


def sizes(docs: DataFrame, names: tuple[str, str, str] = ("key", "size", "hash")) -> DataFrame:
    """`docs` with key (of the source), size (words) and hash (60 bits of doc_id) under the given names."""
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("source")))
    hashed = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    made = key, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")
    return docs.withColumns(dict(zip(names, made, strict=True)))


@any_names
def mix_sources(docs: DataFrame, most: int = 3, with_documents: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of `docs`.

    Whole copies are taken `floor(target / source_size)` times and the rest by a threshold on a hash of
    doc_id, so reruns agree and no document is sorted. `with_documents`: instead the rows of which words
    are taken, with all their columns; of the four new ones one that clashes gets underscores at its end. NULL text or no word: size and taken 0. A NULL
    source is a source of its own, last in order; a NULL doc_id hashes as the empty string; rows that
    repeat a doc_id share its hash and are taken alike. An empty table gives an empty result.
    """
    sized = written(sizes(docs).select("doc_id", "source", "key", "size", "hash"), "sizes")
    target = written(shares(sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), most), "targets")
    whole = F.least(F.lit(most).cast("long"), F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    budget = target.withColumn("whole", whole).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = written(budget.join(thresholds(sized.select("key", "hash", "size"), budget.select("key", "extra")), "key", "left"), "plan")
    in_rest = (F.col("extra") > 0) & (F.col("threshold").isNull() | (F.col("hash") < F.col("threshold")))
    taken = F.col("size") * F.least(F.col("whole") + in_rest.cast("long"), F.lit(most))
    if not with_documents:
        return sized.join(plan, "key").select("doc_id", "size", "source_size", "target", taken.alias("taken"))
    names = []
    for name in ("key", "hash", "size", "source_size", "target", "taken", "whole", "extra", "threshold"):
        names.append(unused(name, [*docs.columns, *names]))
    key_, hash_, size_, source_size_, target_, taken_, whole_, extra_, threshold_ = names
    plan = plan.select(F.col("key").alias(key_), *[F.col(c).alias(n) for c, n in zip(("source_size", "target", "whole", "extra", "threshold"), (source_size_, target_, whole_, extra_, threshold_), strict=True)])
    rest = (F.col(extra_) > 0) & (F.col(threshold_).isNull() | (F.col(hash_) < F.col(threshold_)))
    mixed = sizes(docs, (key_, size_, hash_)).join(plan, key_).withColumn(taken_, F.col(size_) * F.least(F.col(whole_) + rest.cast("long"), F.lit(most)))
    return mixed.where(F.col(taken_) > 0).select(*docs.columns, size_, source_size_, target_, taken_)


SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
  from {docs}),
src as (select source, sum(size)::bigint as source_size from sized group by source),
w as (select *, (row_number() over (order by source asc nulls last) - 1) % 3 + 1 as weight,
             row_number() over (order by source asc nulls last) as place, 3 * source_size as cap from src),
r as (select *, cap / weight as ratio, sum(source_size) over () as total, sum(weight) over () as weights,
             sum(cap) over (order by cap / weight, place) as cap_to, sum(weight) over (order by cap / weight, place) as weight_to from w),
c as (select *, coalesce((total - cap_to + cap) / nullif(weights - weight_to + weight, 0) >= ratio, false) as capped from r),
l as (select *, coalesce(max_by(case when capped then (total - cap_to)::double / nullif(weights - weight_to, 0)::double end,
                                case when capped then weight_to end) over (), total::double / weights::double) as level from c),
t as (select source, source_size, case when capped then cap::double else least(cap::double, level * weight) end as target from l),
b as (select *, coalesce(least(3, floor(target / nullif(source_size, 0))), 0)::bigint as whole from t),
e as (select *, target - whole * source_size as extra from b),
g as (select source, h, sum(size)::bigint as g, sum(sum(size)) over (partition by source order by h) as upto from sized group by source, h)
select s.doc_id, s.size, e.source_size, e.target,
       s.size * least(3, e.whole + case when e.extra > 0 and g.upto - g.g / 2.0 <= e.extra then 1 else 0 end)::bigint as taken
from sized s join e on s.source is not distinct from e.source
join g on g.source is not distinct from s.source and g.h = s.h
"""
