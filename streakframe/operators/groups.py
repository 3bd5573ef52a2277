"""Tables grouped by a key column `index`: look-up, renumbering, concatenation, splitting.

No operator needs the rows to be sorted: a group is what shares a key. Order matters only where a rank is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streakframe.session import settled, ship

KEY = "index"


def unique(df: DataFrame, key: str = KEY) -> DataFrame:
    """Distinct keys."""
    return df.select(key).distinct()


def running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of value over all rows that come before in the given order (a row's own not included).

    Rows are dealt to ranges of the order and summed there; a row for each range says what came before it. No task sees
    more than its range. Rows equal in order are in no particular order.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the ranges come from a sample, so they are settled before they are used twice
    dealt = settled(df.withColumn("_v", value.cast("long")).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(F.sum("_v").alias("_n"))
    before = totals.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.sum("_v").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_v")
    placed = dealt.withColumn("_own", own).join(F.broadcast(before), "_part")  # a row for each range
    return placed.select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))


def positions(df: DataFrame, key: str = KEY) -> DataFrame:
    """(key, position): the place of each distinct key in ascending order, from 0."""
    return running(unique(df, key), [key], F.lit(1), "position")


def reset(df: DataFrame, key: str = KEY) -> DataFrame:
    """Keys renumbered 0 to n-1 in their order."""
    return df.join(positions(df, key), key).withColumn(key, F.col("position")).select(df.columns)


def _wanted(spark: SparkSession, keys: list[int], key: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(keys)), f"_pos long, {key} long")


def _checked(df: DataFrame, keys: list[int], key: str) -> None:
    there = {r[0] for r in df.select(key).where(F.col(key).isin(list(set(keys)))).distinct().collect()}
    if missing := sorted(set(keys) - there):
        raise KeyError(f"{key} has no {missing[:5]}")


def take(df: DataFrame, keys: list[int], key: str = KEY, check: bool = True) -> DataFrame:
    """Rows of the given keys, once for each time that a key is given. A key that isn't there is an error."""
    if check:
        _checked(df, keys, key)
    return df.join(F.broadcast(_wanted(df.sparkSession, keys, key)), key).select(df.columns)


def loc(df: DataFrame, keys: list[int], key: str = KEY, check: bool = True) -> DataFrame:
    """As take; the key becomes its place in `keys`."""
    if check:
        _checked(df, keys, key)
    return df.join(F.broadcast(_wanted(df.sparkSession, keys, key)), key).withColumn(key, F.col("_pos")).select(df.columns)


def iloc(df: DataFrame, places: list[int], key: str = KEY) -> DataFrame:
    """As loc, by places in the list of distinct keys; a negative place counts from the end."""
    placed = positions(df, key)
    if any(p < 0 for p in places):
        n = placed.count()
        places = [p + n if p < 0 else p for p in places]
    wanted = df.sparkSession.createDataFrame(list(enumerate(places)), "_pos long, position long")
    found = placed.join(F.broadcast(wanted), "position")
    return df.join(found, key).withColumn(key, F.col("_pos")).select(df.columns)


def get_index(df: DataFrame, queries: DataFrame, key: str = KEY) -> DataFrame:
    """(query, row) for each row of df that has a query's key. df: (row, key); queries: (query, key)."""
    return queries.join(df, key).select("query", "row")


def insert_index(df: DataFrame, queries: DataFrame, key: str = KEY) -> DataFrame:
    """(key, place): where each key that df lacks would be put, as the number of df's keys below it."""
    missing = queries.select(key).distinct().join(unique(df, key), key, "left_anti")
    both = counts(df, key).unionByName(missing.select(key, F.lit(0).cast("long").alias("n")))
    return running(both, [key], F.col("n"), "place").where("n = 0").select(key, "place")


def monotonicity(df: DataFrame, order: str, key: str = KEY) -> DataFrame:
    """One row: is_increasing, is_decreasing, is_unique. order: a row number without gaps, so that neighbours meet by a join."""
    after = df.select((F.col(order) - 1).alias(order), F.col(key).alias("_after"))
    steps = df.select(order, key).join(after, order, "left")
    return steps.agg(
        F.bool_and(F.coalesce(F.col("_after") >= F.col(key), F.lit(True))).alias("is_increasing"),
        F.bool_and(F.coalesce(F.col("_after") <= F.col(key), F.lit(True))).alias("is_decreasing"),
        (F.count_distinct(key) == F.count(key)).alias("is_unique"),
    )


def concatenate(tables: list[DataFrame], key: str | None = KEY) -> DataFrame:
    """All rows of all tables. With a key, a table whose first key is below what is there already moves up as a whole.

    Empty tables are skipped; if all are empty there is nothing to concatenate, which is an error.
    """
    if not tables:
        raise ValueError("nothing to concatenate")
    if key is None:
        return reduce(DataFrame.unionByName, tables)
    ends = [t.agg(F.min(key), F.max(key)).first() for t in tables]
    out, following = [], None
    for t, (low, high) in zip(tables, ends, strict=True):
        if low is None:
            continue
        shift = following - low if following is not None and low < following else 0
        out.append(t.withColumn(key, F.col(key) + shift))
        following = high + shift + 1
    if not out:
        raise ValueError("all tables are empty")
    return reduce(DataFrame.unionByName, out)


def stack(tables: list[DataFrame], axis: str = "block") -> DataFrame:
    """All rows, with the number of their table."""
    if not tables:
        raise ValueError("nothing to stack")
    return reduce(DataFrame.unionByName, [t.withColumn(axis, F.lit(k)) for k, t in enumerate(tables)])


def reshape(df: DataFrame, size: int, order: str, key: str | None = KEY) -> DataFrame:
    """Rows gathered by `size` in the order of the row number `order`: (block, [key], rows).

    A block whose rows have several keys is an error.
    """
    block = F.floor(F.col(order) / size).alias("block")
    rest = [c for c in df.columns if c not in (key, order)]
    rows = F.sort_array(F.collect_list(F.struct(order, *rest))).alias("rows")
    if key is None:
        return df.groupBy(block).agg(rows)
    one = F.when(F.count_distinct(key) == 1, F.min(key)).otherwise(F.raise_error(F.lit("rows of a block have several keys")).cast("long"))
    return df.groupBy(block).agg(one.alias(key), rows)


def split(df: DataFrame, chunks: int, order: list[str]) -> DataFrame:
    """Adds `chunk`, from 0: contiguous parts in the given order, the first ones a row longer where it doesn't come out even."""
    size, longer = divmod(df.count(), chunks)
    row, edge = F.col("_row"), longer * (size + 1)
    late = F.floor((row - edge) / max(1, size)) + longer
    return running(df, order, F.lit(1), "_row").withColumn("chunk", F.when(row < edge, F.floor(row / (size + 1))).otherwise(late)).drop("_row")


def where_range(df: DataFrame, **bounds: tuple[float, float]) -> DataFrame:
    """Rows with lo <= column < hi for each column given."""
    return df.where(reduce(Column.__and__, [(F.col(c) >= lo) & (F.col(c) < hi) for c, (lo, hi) in bounds.items()]))


def counts(df: DataFrame, key: str = KEY) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def hits(df: DataFrame, threshold: int, key: str = KEY) -> DataFrame:
    """Rows of the groups with more than `threshold` rows."""
    return df.join(counts(df, key).where(F.col("n") > threshold).select(key), key, "left_semi").select(df.columns)


def keep_best(df: DataFrame, value: Column | str, quantile: float, key: str = KEY, tie: str | None = None) -> DataFrame:
    """The first rows of each group by value, fewer than quantile times its size."""
    w = Window.partitionBy(key)
    rank = F.row_number().over(w.orderBy(value, *([tie] if tie else []))) - 1
    return df.withColumn("_rank", rank).withColumn("_n", F.count("*").over(w)).where(F.col("_rank") < quantile * F.col("_n")).select(df.columns)


def windows_of(spark: SparkSession, frames: int, size: int, spacing: int) -> DataFrame:
    """(window, frame): `size` frames from every `spacing`-th one on, as far as whole windows go."""
    starts = F.explode(F.sequence(F.lit(0), F.lit(max(0, frames - size)), F.lit(spacing))).alias("start")
    rows = spark.range(1).select(starts).select((F.col("start") / spacing).cast("long").alias("window"), F.explode(F.sequence("start", F.col("start") + size - 1)).alias("frame"))
    return rows.where(F.col("frame") < frames)


def consecutive(df: DataFrame, order: list[str], ends: dict[str, str], key: str = KEY) -> DataFrame:
    """Each row with the next row's columns of its group, under the names given; null in the last."""
    after = Window.partitionBy(key).orderBy(*order)
    return df.withColumns({new: F.lead(old).over(after) for old, new in ends.items()})


def ranking(df: DataFrame, order: list[Column | str], key: str = KEY) -> DataFrame:
    """Adds `rank` within each group, from 0."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def positional_zip(one: DataFrame, one_order: list[str], other: DataFrame, other_order: list[str]) -> DataFrame:
    """Rows of two tables side by side by their place in order; a single row goes with every one. Other lengths must agree."""
    n, m = one.count(), other.count()
    if n != m and 1 not in (n, m):
        raise ValueError(f"{n} rows against {m}")
    if n != m:
        longer, single = (other, one) if n == 1 else (one, other)
        order = other_order if n == 1 else one_order
        return running(longer, order, F.lit(1), "position").join(F.broadcast(single), how="cross")
    return running(one, one_order, F.lit(1), "position").join(running(other, other_order, F.lit(1), "position"), "position")


def _whole(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Tables of whole groups, from batches in which a group's rows come together."""
    held: list[pd.DataFrame] = []  # the last group may go on in the next batch
    for b in batches:
        if not len(b):
            continue
        names = b[key]
        same = (names.isna() if pd.isna(names.iloc[-1]) else names == names.iloc[-1]).to_numpy()
        cut = len(b) - int(same[::-1].argmin()) if not same.all() else 0
        first = held[-1][key].iloc[-1] if held else None
        goes_on = bool(held) and (names.iloc[0] == first or pd.isna(names.iloc[0]) and pd.isna(first))
        if held and (cut or not goes_on):
            begun = [b.iloc[:cut]] if goes_on else []
            yield pd.concat([*held, *begun], ignore_index=True) if len(held) + len(begun) > 1 else held[0]
            if cut and not goes_on:
                yield b.iloc[:cut]
            held = []
        elif cut:
            yield b.iloc[:cut]
        held.append(b.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def per_group(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = KEY, many: bool = False, gathered: bool = False) -> DataFrame:
    """function applied to the rows of each group as one table; a group must fit a worker.

    Groups come sorted in large batches, so that a small group costs no round trip of its own. many: function takes the rows
    of any number of whole groups and answers for each of them, for groups so small that a call for each would take most of
    the time. gathered: the rows of a group come together already.
    """
    ship(df.sparkSession)

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        if many:
            return function(rows)
        return pd.concat([function(own) for _, own in rows.groupby(key, sort=False, dropna=False)])

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole(batches, key):
            yield each(rows)

    return (df if gathered else df.repartition(key).sortWithinPartitions(key)).mapInPandas(found, schema)


def replace(df: DataFrame, **values: Column) -> DataFrame:
    """df with columns replaced; a name that isn't there is an error."""
    if unknown := values.keys() - set(df.columns):
        raise KeyError(f"no columns {sorted(unknown)}")
    return df.withColumns(values)
