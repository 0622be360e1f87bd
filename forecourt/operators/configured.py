"""Listings against many filter configurations at once.

A price range is covered by a few nested bins (each twice as wide as the one below), a price lies in one bin of every
width; so a listing meets a configuration in exactly one bin, by an equal join, and bounds, years and keywords are checked there. Configurations and
listings of all sizes share one plan.

Where only totals a configuration are asked, its listings are never made: they may be as many as listings times
configurations. Listings are cut by price into cells of bounded size; a price range covers whole cells, which are added
up beforehand, and parts of at most two, in which it is a run of the listings sorted by price.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.operators.once import once
from forecourt.session import cut_lineage, ship_package

LEVELS = 10  # 2^10 narrowest bins
BROADCAST_BINS = 200_000  # some ten megabytes
SPREAD = 32
ROWS_PER_CELL = 100_000
WHOLE = -1  # number of the cell of whole cells; there, the place of listings without a price


def price_bin(price: Column) -> Column:
    """Number of a price's narrowest bin; grows with the price, so a range of prices is a range of bins. Null without one."""
    place = F.least(F.lit(2**LEVELS - 1), F.floor(F.log2(F.greatest(price, F.lit(0.0)) + 1) * 32).cast("int"))
    return F.when(price.isNotNull(), place)


def bins_of(price: Column) -> Column:
    """The bin of every width around a price; the widest one only, where there is none."""
    place = price_bin(price)
    every = F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda level: level * 2**LEVELS + F.call_function("shiftright", place, level))
    return F.when(price.isNotNull(), every).otherwise(F.array(F.lit(LEVELS * 2**LEVELS)))


def cover_of(low: Column, high: Column) -> Column:
    """The fewest bins that cover a price range: at each width at most the first and the last that fit and whose wider bin does not."""
    first = F.coalesce(price_bin(low), F.lit(0))
    last = F.coalesce(price_bin(high), F.lit(2**LEVELS - 1))

    def at(level: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1), level)
        left = F.floor((first + width - 1) / width).cast("int")
        right = F.floor((last + 1) / width).cast("int") - 1
        fits = left <= right
        number = lambda k: level * 2**LEVELS + k
        return F.array_distinct(F.array_compact(F.array(F.when(fits & (left % 2 == 1), number(left)), F.when(fits & (right % 2 == 0), number(right)))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at))


def within() -> Column:
    """The bounds of a configuration; unset ones are open, a listing without the value passes only those."""
    inside = F.lit(True)
    for column, low, high in (("price", "min_price", "max_price"), ("year", "year_from", "year_to")):
        inside = inside & (F.col(low).isNull() | (F.col(column) >= F.col(low))) & (F.col(high).isNull() | (F.col(column) <= F.col(high)))
    return F.coalesce(inside, F.lit(False))


def lower_words() -> Column:
    return F.transform(F.array_compact(F.coalesce("exclude_keywords", F.array().cast("array<string>"))), lambda k: F.lower(k))


def configured(
    ads: DataFrame, configs: DataFrame, text_column: str = "title", broadcast_bins: int = BROADCAST_BINS, totals_of: str | None = None,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """A row for each listing and configuration that it passes: ``job`` and the listing's columns.

    ``configs`` have job, min_price, max_price, year_from, year_to and exclude_keywords, each of which may be null. Few
    configurations are sent to the listings; many meet them bin by bin, where a bin with many listings is dealt to
    several tasks.

    With ``totals_of``, a column of the listings, those rows are not made but added up: some rows a job with the number ``n`` of
    its listings, the ``first`` and ``last`` value of that column and the ``total`` price, to be added up themselves.
    """
    if totals_of is not None:
        return _totals(ads, configs, text_column, totals_of, rows_per_cell)
    given = configs.select("job", "min_price", "max_price", "year_from", "year_to", lower_words().alias("__words"), F.explode(cover_of(F.col("min_price"), F.col("max_price"))).alias("bin"))
    placed = ads.withColumn("__text", F.lower(F.coalesce(text_column, F.lit("")))).withColumn("bin", F.explode(bins_of(F.col("price").cast("double"))))
    bins = given.limit(broadcast_bins + 1).count()
    if bins <= broadcast_bins:
        met = placed.join(F.broadcast(given), "bin")
    else:
        spread = placed.withColumn("part", F.pmod(F.xxhash64(*ads.columns), F.lit(SPREAD)).cast("int"))
        met = spread.join(given.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))), ["bin", "part"])
    named = F.exists("__words", lambda k: F.contains(F.col("__text"), k))
    return once(met.filter(within()), "__named", named).filter("not __named").select("job", *ads.columns)


def _totals(ads: DataFrame, configs: DataFrame, text_column: str, value: str, rows_per_cell: int) -> DataFrame:
    """The sums behind ``configured``; work and rows are those of listings and configurations, not of their pairs.

    Listings that no year and no keyword tells apart are a group; every keyword of the configurations is looked for once a listing.
    """
    ship_package(ads.sparkSession)
    price = lambda c: F.col(c).cast("double") + F.lit(0.0)  # one zero
    wanted = configs.select("job", price("min_price").alias("low"), price("max_price").alias("high"), F.col("year_from").cast("int").alias("year_from"),
                            F.col("year_to").cast("int").alias("year_to"), F.array_sort(F.array_distinct(lower_words())).alias("words"))
    every = wanted.select(F.explode("words").alias("word")).agg(F.collect_set("word").alias("every"))
    text = F.lower(F.coalesce(text_column, F.lit("")))
    named = F.array_sort(F.filter("every", lambda k: F.contains(F.col("text"), k)))
    rows = ads.select(F.col(value).alias("value"), price("price").alias("key"), F.col("year").cast("int").alias("year"), text.alias("text"))
    rows = cut_lineage(rows.crossJoin(F.broadcast(every)).select("value", "key", "year", named.alias("named")))

    n = rows.count()
    shares = [i * rows_per_cell / n for i in range(1, -(-n // rows_per_cell))]
    cuts = rows.agg(F.percentile_approx("key", shares, 10 * len(shares) + 100)).first()[0] if shares else None
    cuts = sorted({c for c in cuts or [] if abs(c) < float("inf")})
    splits = [float("-inf"), *cuts, float("inf")] if cuts else [float("-inf"), 0.0, float("inf")]
    celled = lambda df, c, to: (
        Bucketizer(splits=splits, inputCol=c, outputCol=to, handleInvalid="keep").transform(df)
        .withColumn(to, F.when(F.col(c).isNull(), None).when(F.isnan(c), F.lit(len(splits) - 2)).otherwise(F.col(to).cast("int")))
    )
    rows = celled(rows, "key", "cell")
    single = rows.filter("key is not null").select("cell", "key", "year", "named", F.lit(1).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("priced"),
                                                   F.col("value").alias("first"), F.col("value").alias("last"), F.col("key").alias("total"))
    whole = rows.groupBy("cell", "year", "named").agg(
        F.count(F.lit(1)).alias("n"), F.count("key").alias("priced"), F.min("value").alias("first"), F.max("value").alias("last"), F.sum("key").alias("total")
    ).withColumn("key", F.coalesce("cell", F.lit(WHOLE)).cast("double")).withColumn("cell", F.lit(WHOLE))
    listed = single.unionByName(whole)

    placed = celled(celled(wanted, "low", "first_cell"), "high", "last_cell").withColumns({
        "lowest": F.coalesce(F.col("first_cell") + 1, F.when(F.col("high").isNull(), F.lit(WHOLE)).otherwise(F.lit(0))),
        "highest": F.coalesce(F.col("last_cell") - 1, F.lit(len(splits) - 2)),
    })
    a, b, below, above = F.col("first_cell"), F.col("last_cell"), F.lit(float("-inf")), F.lit(float("nan"))
    piece = lambda cell, low, high: F.struct(cell.cast("int").alias("cell"), low.cast("double").alias("low"), high.cast("double").alias("high"))
    apart = F.coalesce(a < b, F.lit(True))
    pieces = F.array(
        F.when(a == b, piece(a, F.col("low"), F.col("high"))),
        F.when(a.isNotNull() & apart, piece(a, F.col("low"), above)),
        F.when(b.isNotNull() & apart, piece(b, below, F.col("high"))),
        F.when(F.col("lowest") <= F.col("highest"), piece(F.lit(WHOLE), F.col("lowest"), F.col("highest"))),
    )
    asked = placed.select("job", "year_from", "year_to", "words", F.explode(F.array_compact(pieces)).alias("piece")).select("job", "year_from", "year_to", "words", "piece.*")

    # A cell with many listings is cut into parts, one with many ranges has its listings in several places.
    counts = listed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).join(asked.groupBy("cell").agg(F.count(F.lit(1)).alias("ranges")), "cell")
    some = lambda c: F.ceil(F.col(c) / F.lit(2 * rows_per_cell)).cast("int")
    dealt = F.broadcast(counts.select("cell", some("rows").alias("parts"), some("ranges").alias("shares")))
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = listed.join(dealt, "cell").withColumn("part", F.pmod(F.xxhash64("first", "key", "year"), "parts").cast("int")).withColumn("share", numbers("shares"))
    right = asked.join(dealt, "cell").withColumn("share", F.pmod(F.xxhash64("job", "low", "high"), "shares").cast("int")).withColumn("part", numbers("parts"))
    keys = ["cell", "part", "share"]
    left, right = left.drop("parts", "shares"), right.drop("parts", "shares")
    kinds = {f.name: f.dataType.simpleString() for f in [*left.schema, *right.schema]}
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _run_sums, f"job {kinds['job']}, n bigint, first {kinds['first']}, last {kinds['last']}, total double"
    )


def _extremes(ranks: np.ndarray, pick) -> list[np.ndarray]:
    """``pick`` of every run of 1, 2, 4... ranks, by its start."""
    tables = [ranks]
    while 2 ** len(tables) <= len(ranks):
        half = 2 ** (len(tables) - 1)
        tables.append(pick(tables[-1][:-half], tables[-1][half:]))
    return tables


def _run_sums(listed: pa.Table, asked: pa.Table) -> pa.Table:
    """What each price range finds in one cell: a run of every group's listings in the order of their keys."""
    numbers = lambda t, c, none: t[c].to_pandas().fillna(none).to_numpy()
    as_tuples = lambda t, c: [tuple(v) for v in t[c].to_pylist()]
    found_n, found_priced = (np.zeros(asked.num_rows, np.int64) for _ in range(2))
    sums = {k: np.zeros(asked.num_rows, np.longdouble) for k in ("finite", "up", "down", "nan")}
    values = pa.chunked_array([*listed["first"].chunks, *listed["last"].chunks], listed.schema.field("first").type).combine_chunks()
    order = pc.array_sort_indices(values)  # nulls last
    rank = np.empty(len(values), np.int64)
    rank[order.to_numpy()] = np.arange(len(values))
    nothing = values.is_null().to_numpy(zero_copy_only=False)
    size = listed.num_rows
    lowest, highest = np.full(asked.num_rows, len(values)), np.full(asked.num_rows, -1)

    key = listed["key"].to_numpy()
    group_of, groups = {}, []
    for group in zip(listed["year"].to_pylist(), as_tuples(listed, "named"), strict=True):
        groups.append(group_of.setdefault(group, len(group_of)))
    place = np.lexsort((key, groups)) if size else np.zeros(0, np.int64)
    key, groups = key[place], np.asarray(groups, np.int64)[place]
    running = lambda v, kind: np.concatenate([np.zeros(1, kind), np.cumsum(v[place].astype(kind))])
    total = listed["total"].to_pandas().fillna(np.nan).to_numpy(dtype=np.float64)
    priced = listed["priced"].to_numpy()
    finite = np.isfinite(total)
    runs = {"finite": running(np.where(finite, total, 0), np.longdouble), "up": running(total == np.inf, np.int64),
            "down": running(total == -np.inf, np.int64), "nan": running(np.isnan(total) & (priced > 0), np.int64)}
    n_run, priced_run = running(listed["n"].to_numpy(), np.int64), running(priced, np.int64)
    least = _extremes(np.where(nothing, len(values), rank)[:size][place], np.minimum)
    most = _extremes(np.where(nothing, -1, rank)[size:][place], np.maximum)

    from_, to = (asked[c].to_pandas() for c in ("year_from", "year_to"))
    low, high = asked["low"].to_numpy(), asked["high"].to_numpy()
    list_of = {}
    lists = np.asarray([list_of.setdefault(w, len(list_of)) for w in as_tuples(asked, "words")], np.int64)
    for (year, words), number in group_of.items():
        start, end = np.searchsorted(groups, [number, number + 1])
        free = np.asarray([not set(words) & set(w) for w in list_of], bool)[lists]
        fits = from_.isna() & to.isna() if year is None else (from_.isna() | (from_ <= year)) & (to.isna() | (to >= year))
        which = np.flatnonzero(free & fits.to_numpy(bool))
        a = start + np.searchsorted(key[start:end], low[which], "left")
        b = start + np.searchsorted(key[start:end], high[which], "right")
        some = a < b
        which, a, b = which[some], a[some], b[some]
        found_n[which] += n_run[b] - n_run[a]
        found_priced[which] += priced_run[b] - priced_run[a]
        for name, run in runs.items():
            sums[name][which] += run[b] - run[a]
        level = np.frexp((b - a).astype(float))[1] - 1
        for k in np.unique(level):
            at = level == k
            lowest[which[at]] = reduce(np.minimum, (lowest[which[at]], least[k][a[at]], least[k][b[at] - 2**k]))
            highest[which[at]] = reduce(np.maximum, (highest[which[at]], most[k][a[at]], most[k][b[at] - 2**k]))

    hit = np.flatnonzero(found_n)
    total = sums["finite"].astype(np.float64)
    total[sums["up"] > 0] = np.inf
    total[sums["down"] > 0] = -np.inf
    total[(sums["nan"] > 0) | ((sums["up"] > 0) & (sums["down"] > 0))] = np.nan
    valued = lambda ranks, missing: values.take(order.take(pa.array(np.where(missing, 0, ranks), pa.int64(), mask=missing)))
    return pa.table({
        "job": asked["job"].take(pa.array(hit)), "n": found_n[hit], "first": valued(lowest[hit], lowest[hit] == len(values)),
        "last": valued(highest[hit], highest[hit] < 0), "total": pa.array(total[hit], pa.float64(), mask=found_priced[hit] == 0),
    })
