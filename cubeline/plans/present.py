"""Shapes of results for people: top users and the rest, last periods, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics, timefn


def _folded(series: DataFrame, n: int, rest: str) -> DataFrame:
    """(user, folded, time_ms, value, total)."""
    totals = series.groupBy("user").agg(F.sum("value").alias("total"))
    top = totals.orderBy(F.desc("total"), "user").limit(n).select(F.col("user").alias("u"), F.lit(True).alias("named"))
    others = totals.agg(F.concat((F.count(F.lit(1)) - n).cast("string"), F.lit(f" {rest}")).alias("others"))
    rows = series.join(F.broadcast(top), F.col("user").eqNullSafe(F.col("u")), "left").crossJoin(F.broadcast(others))  # n rows, one row
    folded = F.col("named").isNull()
    rows = rows.groupBy(F.when(folded, F.col("others")).otherwise(F.col("user")).alias("user"), folded.alias("folded"), "time_ms").agg(F.sum("value").alias("value"))
    return rows.withColumn("total", F.sum("value").over(Window.partitionBy("user", "folded")))  # a row for each period shown


def top_and_rest(series: DataFrame, n: int = 10, rest: str = "users") -> DataFrame:
    """(user, time_ms, value, total): the n users of largest total, and all others as one series ``<k> <rest>``, lightest first.

    Only the n names are gathered and broadcast; all users are counted by partial sums.
    """
    return _folded(series, n, rest).orderBy(F.desc("folded"), "total", F.desc("user"), "time_ms").select("user", "time_ms", "value", "total")


def graph_series(selected: DataFrame, metric: str, others: DataFrame | None = None, count: int = 0, n: int = 10, aggregate_selected: bool = False) -> DataFrame:
    """(position, user, time_ms, value, disabled): what a graph draws, from the back to the front; minutes as hours.

    selected: (user, time_ms, value), dense. Its n heaviest users are in front, the
    heaviest first; behind them ``<k> users``, all others (or all, if they are to be
    aggregated); last of all ``<count> more users``, the series ``others`` (time_ms,
    value), which is not shown at first. Without a selected user it is ``<count> users``
    and shown.
    """
    # order from the back: others, folded users, users by total
    rows = _folded(selected, 0 if aggregate_selected else n, "users").select((F.lit(2) - F.col("folded").cast("int")).alias("layer"), "user", "time_ms", "value", "total", F.lit(False).alias("disabled"))
    if others is not None and count > 0:
        some = selected.agg((F.count(F.lit(1)) > 0).alias("some"))
        more = others.crossJoin(F.broadcast(some))  # one row
        name = F.when(F.col("some"), f"{count} more users").otherwise(f"{count} users")
        rows = rows.unionByName(more.select(F.lit(0).alias("layer"), name.alias("user"), "time_ms", "value", F.lit(0).cast(rows.schema["total"].dataType).alias("total"), F.col("some").alias("disabled")))
    named = rows.groupBy("layer", "user").agg(F.max("total").alias("total"))
    # a row for each series shown
    position = named.select("layer", "user", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("layer", "total", F.desc("user"))) - 1).alias("position"))
    value = F.col("value") / 60 if metrics.in_minutes(metric) else F.col("value")
    return rows.join(F.broadcast(position), ["layer", "user"]).select("position", "user", "time_ms", value.alias("value"), "disabled").orderBy("position", "time_ms")


def last_periods(series: DataFrame, metric: str, n: int = 7, limit: int | None = None, offset: int = 0, order: str | int = "total", descending: bool = True) -> DataFrame:
    """(user, recent, total): values of the last n periods, oldest first, and the total of all; a page of it.

    order: ``total``, ``user``, or the number of a period shown, from 0; ties by user.
    """
    times = series.select("time_ms").distinct().orderBy(F.desc("time_ms")).limit(n).withColumn("shown", F.lit(True))
    rows = series.join(F.broadcast(times), "time_ms", "left")
    value = metrics.shown(metric, F.col("value"))
    recent = F.transform(F.sort_array(F.collect_list(F.when(F.col("shown"), F.struct("time_ms", value.alias("value"))))), lambda x: x["value"])
    by = F.try_element_at("recent", F.lit(order + 1)) if isinstance(order, int) else F.col(order)
    out = rows.groupBy("user").agg(recent.alias("recent"), metrics.shown(metric, F.sum("value")).alias("total")).orderBy(by.desc() if descending else by.asc(), "user")
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def csv_pivot(series: DataFrame, users: list[str], metric: str, zone: str = "UTC", compat: bool = False) -> DataFrame:
    """(time, a column for each user in the order given): a row for each period."""
    wide = series.groupBy("time_ms").pivot("user", list(dict.fromkeys(users))).agg(F.first("value"))
    shown = [metrics.shown(metric, F.col(f"`{u}`"), compat).alias(u) for u in dict.fromkeys(users)]
    return wide.orderBy("time_ms").select(timefn.iso_day(F.col("time_ms"), zone).alias("time"), *shown)


def write_csv(pivot: DataFrame, path: str) -> None:
    pivot.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a row for each period shown


def labelled(series: DataFrame, unit: str, zone: str = "UTC") -> DataFrame:
    return series.withColumn("label", timefn.label(F.col("time_ms"), unit, zone))
