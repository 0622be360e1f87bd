"""Mixing sources to target weights: hash-threshold histograms instead of a sort.

A document's ticket is a 60-bit hash of its id. Each source takes every document some whole number of times and, for
what its target leaves over, the documents whose ticket is under a threshold. The threshold is found in five nested
levels of 4,096 buckets: sizes are summed by source and bucket, the bucket that holds the threshold is found from
running sums, and only that bucket is summed again by the next twelve bits. The last level tells tickets apart, and
takes a ticket if the middle of its documents' words lies within the budget. So the mix is the same on every run.

A null text has size 0; a null source is a source of its own, the last. Equal doc_ids share a ticket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.llm.common import cut_lineage

WEIGHTS = (5, 2, 1)
CEILING = 3
LEVEL_BITS = 12
LEVELS = 5
BROADCAST_SOURCES = 200_000  # rows of about 60 bytes: 12 MB


def ticket(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size, target): shares by weight, none above the ceiling, the excess shared again.

    All shares are ``level * weight`` up to the ceiling, so the level follows from the sources in the order in which
    they reach their ceiling. One row a source: the windows here are over sources, not documents.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int"))
    rows = sources.withColumn("number", number).withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * ceiling)
    rows = rows.withColumn("reach", F.col("most") / F.col("weight"))
    order = Window.orderBy("reach", "number")
    rows = rows.withColumn("before", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    everything = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("attempt", (F.sum("source_size").over(everything) - F.col("before")) / F.col("left"))
    level = F.max(F.when(F.col("attempt") <= F.col("reach"), F.col("attempt"))).over(everything)
    return rows.select("source", "source_size", F.least(F.col("most").cast("double"), level * F.col("weight")).alias("target"))


def _sources_joined(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    right = sources.withColumnRenamed("source", "of_source")
    return rows.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")


def thresholds(sized: DataFrame, shares: DataFrame, few: bool) -> DataFrame:
    """(source, source_size, target, times, threshold): tickets under the threshold are taken once more."""
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = shares.withColumn("times", times.cast("long")).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    state = state.withColumn("prefix", F.lit(0).cast("long"))
    keys = state.columns
    for depth in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - depth)
        inside = _sources_joined(sized, state, few).where(F.shiftright("ticket", shift + LEVEL_BITS) == F.col("prefix"))
        sums = inside.groupBy("source", F.shiftright("ticket", shift).alias("bucket")).agg(F.sum("size").alias("held"))
        running = sums.withColumn("until", F.sum("held").over(Window.partitionBy("source").orderBy("bucket")))
        running = _sources_joined(running, state.select("source", "rest"), few)
        over = F.col("until") > F.col("rest") if depth < LEVELS else F.col("until") - F.col("held") / 2 > F.col("rest")
        # The first bucket that goes over the rest; past the last one if none does.
        cut = running.groupBy("source").agg(
            F.min(F.when(over, F.col("bucket"))).alias("cut"), F.max("bucket").alias("last"),
            F.max(F.when(~over, F.col("until"))).alias("within"),
        ).withColumnRenamed("source", "cut_source")
        state = state.join(F.broadcast(cut) if few else cut, F.col("source").eqNullSafe(F.col("cut_source")), "left")
        state = state.withColumn("prefix", F.coalesce("cut", F.col("last") + 1, F.shiftleft("prefix", LEVEL_BITS)))
        state = cut_lineage(state.withColumn("rest", F.col("rest") - F.coalesce("within", F.lit(0))).select(*keys))
    return state.select("source", "source_size", "target", "times", F.col("prefix").alias("threshold"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row: the mix has ``copies`` of each."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
                        ticket(F.col("doc_id")).alias("ticket"))
    sized = cut_lineage(sized)
    sources = cut_lineage(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    few = sources.count() <= BROADCAST_SOURCES
    found = thresholds(sized, cut_lineage(targets(sources, weights, ceiling)), few)
    rows = _sources_joined(sized, found, few)
    # Only documents without words can lie under a threshold that has no budget left.
    rows = rows.withColumn("copies", F.least(F.col("times") + (F.col("ticket") < F.col("threshold")).cast("long"), F.lit(ceiling)))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         cast(concat('0x', substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15)) as bigint) as ticket
  from documents),
sources as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
weighed as (select *, [5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as weight,
                   row_number() over (order by source nulls last) as number, source_size * 3 as most from sources),
ordered as (select *, cast(most as double) / weight as reach,
                   coalesce(sum(most) over (order by cast(most as double) / weight, number rows between unbounded preceding and 1 preceding), 0) as before,
                   sum(weight) over (order by cast(most as double) / weight, number rows between current row and unbounded following) as remaining,
                   sum(source_size) over () as total from weighed),
levels as (select *, cast(total - before as double) / cast(remaining as double) as attempt from ordered),
shares as (select source, source_size, least(cast(most as double), weight * (select max(attempt) from levels where attempt <= reach)) as target from levels),
budgets as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as times from shares),
held as (select source, ticket, sum(size) as held, sum(sum(size)) over (partition by source order by ticket) as until from sized group by source, ticket),
joined as (select d.doc_id, d.size, b.source_size, b.target, b.times, h.until - h.held / 2.0 <= b.target - b.times * b.source_size as more
  from sized d join budgets b on d.source is not distinct from b.source
  join held h on d.source is not distinct from h.source and d.ticket = h.ticket)
select doc_id, size, source_size, target, cast(size * (times + case when more then 1 else 0 end) as bigint) as taken from joined
"""
