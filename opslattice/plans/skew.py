"""Joins and windows that stay balanced when one key holds much of the data.

Aggregates need nothing special (Spark combines on the map side), but a join or
a window sends every row of a key to one task. The helpers here split such keys
and stay exact: no row is dropped and no key is capped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000  # a key with fewer rows than this fits one task
SHARES = 10_000  # a key with less than this part of all rows is no larger than a fair share of one task
NULL_SALTS = 64  # rows with a null key match nothing and are spread over so many values


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, _salts): the keys that are too large for one task, and over how many values to spread each.

    A key is too large with hot_rows rows or more, if these are 1/SHARES of all rows or more. So at most SHARES keys can be,
    whatever the data, and each is spread by its own size.
    """
    return hot_counts(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), keys, "_rows", hot_rows)


def hot_counts(counts: DataFrame, keys: list[str], rows: str, hot_rows: int = HOT_ROWS, total: int | None = None) -> DataFrame:
    """The same from a frame that has one row per key and its number of rows; total: the number of all rows, if it is known."""
    return _hot(counts, keys, rows, hot_rows, total).drop("_rows")


def _hot(counts: DataFrame, keys: list[str], rows: str, hot_rows: int, total: int | None = None) -> DataFrame:
    """(keys, _rows, _salts)"""
    large = counts.select(*keys, F.col(rows).alias("_rows")).filter(F.col("_rows") >= hot_rows)
    if total is None:
        one = F.lit(1).alias("_one")
        whole = counts.agg(F.greatest(F.lit(hot_rows), F.ceil(F.sum(rows) / SHARES)).alias("_most"), one)
        large = large.withColumn("_one", one).join(F.broadcast(whole), "_one")
    else:
        large = large.withColumn("_most", F.lit(max(hot_rows, -(-total // SHARES))))
    return large.filter(F.col("_rows") >= F.col("_most")).select(*keys, "_rows", (F.ceil(F.col("_rows") / F.col("_most")) + 1).cast("int").alias("_salts"))


def with_salts(counts: DataFrame, rows: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """counts, one row per key, with _salts: over how many values to spread the rows of the key, by the same measure; 1 if it is not hot."""
    one = F.lit(1).alias("_one")
    whole = counts.agg(F.greatest(F.lit(hot_rows), F.ceil(F.sum(rows) / SHARES)).alias("_most"), one)
    salts = F.when(F.col(rows) >= F.col("_most"), F.ceil(F.col(rows) / F.col("_most")) + 1).otherwise(1)
    return counts.withColumn("_one", one).join(F.broadcast(whole), "_one").withColumn("_salts", salts.cast("int")).drop("_one", "_most")


def salt_rows(df: DataFrame, hot: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """Add _salt: rows of hot or null keys are spread, others get 0."""
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salts = F.coalesce("_salts", F.when(no_key, NULL_SALTS), F.lit(1))
    return df.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_salts")


def replicate_rows(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Add _salt: one copy per salt for rows of hot keys, a single copy with 0 otherwise."""
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    return df.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(copies)).drop("_salts")


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    spread: str,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Equi-join in which a hot key of `rows` is spread by the unique column `spread`."""
    hot = hot_keys(rows, keys, hot_rows) if hot is None else hot
    left = salt_rows(rows, hot, keys, F.col(spread))
    right = replicate_rows(lookup, hot, keys)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


SPREAD = 16  # parts of the rows of every key in a fanning join
FAN_TASKS = 128  # tasks of a fanning join


def fanning_join(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Inner equi-join of two frames that are small against its result.

    Tasks are planned by the rows they read, which would put such a join into one task. Here the rows of every key are cut into
    SPREAD parts by the column `spread`, the lookup is copied to each, and the (key, part) are dealt over FAN_TASKS tasks.
    """
    at = [*keys, "_part"]
    placed = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(SPREAD)).cast("int"))
    copies = lookup.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return placed.repartition(FAN_TASKS, *at).hint("merge").join(copies.repartition(FAN_TASKS, *at), at).drop("_part")


def pairs_within(
    df: DataFrame, item: str, member: str, carry: tuple[str, ...] = (), hot_rows: int = 10_000, split: bool = True
) -> DataFrame:
    """(item, a, b, *carry) for members a < b of the same item; df holds distinct (item, member).

    Every row is an edge of the requested graph. A hot item is split over tasks by
    member on one side and replicated on the other. Where it is known that no item is hot, split = False joins by the item alone,
    which needs no shuffle of rows that are dealt by item.
    """
    if not split:
        pairs = df.select(item, F.col(member).alias("a"), *carry).join(df.select(item, F.col(member).alias("b")), item)
        return pairs.filter(F.col("a") < F.col("b")).select(item, "a", "b", *carry)
    hot = hot_keys(df, [item], hot_rows)
    left = salt_rows(df.select(item, member, *carry), hot, [item], F.col(member))
    right = replicate_rows(df.select(item, member), hot, [item])
    pairs = left.withColumnRenamed(member, "a").join(right.withColumnRenamed(member, "b"), [item, "_salt"])
    return pairs.filter(F.col("a") < F.col("b")).select(item, "a", "b", *carry)


def _attach(rows: DataFrame, carried: DataFrame, keys: list[str], column: str) -> DataFrame:
    renamed = carried.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], column)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return rows.join(renamed, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])


DRAWN = 20  # rows of a burst that are drawn for each piece it is cut into


def split_bursts(df: DataFrame, keys: list[str], bucket: str, order: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with its bucket column as (bucket, piece): a (key, bucket) with too many rows is cut into pieces of similar row counts.

    The pieces are ranges of the order columns. Their borders come from about DRAWN rows per piece, drawn by a hash, so borders are
    bounded like the hot keys themselves. Pieces rise with the order, so the windows below can carry from piece to piece as they
    do from bucket to bucket; rows that are equal in all order columns share a piece.
    """
    at = [*keys, bucket]
    hot = _hot(df.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")), at, "_n", hot_rows)
    share = hot.select(*at, F.least(DRAWN * F.col("_salts") / F.col("_rows"), F.lit(1.0)).alias("_share"))
    place = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    unit = F.pmod(F.xxhash64(*order), F.lit(1 << 20)) / (1 << 20)
    drawn = _attach(df.select(*at, *[c for c in order if c not in at]), F.broadcast(share), at, "_share").filter(unit < F.col("_share"))
    borders = drawn.groupBy(*at).agg(F.array_sort(F.collect_list(place)).alias("_all")).select(
        *at, F.filter("_all", lambda _, i: i % DRAWN == DRAWN - 1).alias("_borders"))
    piece = F.coalesce(F.size(F.filter("_borders", lambda b: b <= place)), F.lit(0))
    piece = F.when(F.col("_borders").isNull(), 0).otherwise(piece).alias("piece")
    return _attach(df, F.broadcast(borders), at, "_borders").withColumn(bucket, F.struct(F.col(bucket).alias("bucket"), piece)).drop("_borders")


def history(
    df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, n: int, alias: str = "history"
) -> DataFrame:
    """The previous n values of the same key, oldest first, as an array column.

    `bucket` must rise with `order`. Windows run inside (key, bucket), so a hot key
    is spread over its buckets; the last n values of earlier buckets are carried in.
    """
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    newest = Window.partitionBy(*keys, bucket).orderBy(*[F.desc(c) for c in order])
    local = df.withColumn("_local", F.collect_list(value).over(inner.rowsBetween(-n, -1)))
    tails = (
        df.withColumn("_back", F.row_number().over(newest))
        .filter(F.col("_back") <= n)
        .groupBy(*keys, bucket)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("p"), F.col(value).alias("v")))).alias("_t"))
        .withColumn("_t", F.col("_t.v"))
    )
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(-n, -1)
    carried = tails.withColumn("_carry", F.flatten(F.collect_list("_t").over(earlier)))
    joined = _attach(local, carried, [*keys, bucket], "_carry")
    whole = F.concat(F.coalesce(F.col("_carry"), F.array()), F.col("_local"))
    start = F.greatest(F.size(whole) - n + 1, F.lit(1))
    return joined.withColumn(alias, F.slice(whole, start, F.lit(n))).drop("_local", "_carry")


def previous(
    df: DataFrame, keys: list[str], bucket: str, order: list[str], values: list[str], alias: str = "prev"
) -> DataFrame:
    """The preceding row of the same key as a struct of `values`, null for the first."""
    payload = F.struct(*[F.col(c) for c in values])
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    local = df.withColumn("_local", F.lag(payload).over(inner))
    tails = df.groupBy(*keys, bucket).agg(
        F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], payload.alias("_p"))).alias("_t")
    )
    carried = tails.withColumn("_carry", F.lag("_t._p").over(Window.partitionBy(*keys).orderBy(bucket)))
    joined = _attach(local, carried, [*keys, bucket], "_carry")
    return joined.withColumn(alias, F.coalesce("_local", "_carry")).drop("_local", "_carry")


def numbered(df: DataFrame, keys: list[str], bucket: str, order: list[str], alias: str = "pos") -> DataFrame:
    """1-based position within the key, computed bucket by bucket."""
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    local = df.withColumn("_local", F.row_number().over(inner))
    sizes = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.withColumn("_carry", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    joined = _attach(local, carried, [*keys, bucket], "_carry")
    return joined.withColumn(alias, F.col("_local") + F.col("_carry")).drop("_local", "_carry")


def totalled(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, alias: str) -> DataFrame:
    """Running total of `value` within the key up to and including the current row."""
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.withColumn("_local", F.sum(value).over(inner))
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("_carry", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    joined = _attach(local, carried, [*keys, bucket], "_carry")
    return joined.withColumn(alias, F.col("_local") + F.col("_carry")).drop("_local", "_carry")


def last_seen(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, alias: str) -> DataFrame:
    """The latest non-null `value` of the key up to and including the current row."""
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.withColumn("_local", F.last(value, ignorenulls=True).over(inner))
    position = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    tails = df.groupBy(*keys, bucket).agg(F.max_by(value, F.when(F.col(value).isNotNull(), position)).alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.withColumn("_carry", F.last("_t", ignorenulls=True).over(earlier))
    joined = _attach(local, carried, [*keys, bucket], "_carry")
    return joined.withColumn(alias, F.coalesce("_local", "_carry")).drop("_local", "_carry")
