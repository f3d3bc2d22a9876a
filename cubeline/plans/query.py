"""Usage queries: metric by user and bucket, dense on a calendar axis.

Predicates on cluster, metric, users and time reach the scan, and where a request
says how far log days and usage may be apart, whole days are left out; sums are
partial before their shuffle. Axis and sums are a row for each shown period (and
user), which adaptive execution joins as their size at the time allows.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics, timefn


@dataclass(frozen=True)
class Request:
    cluster: str
    metric: str
    start_ms: int
    end_ms: int
    unit: str = "DAYS"
    zone: str = "UTC"
    users: tuple[str, ...] = field(default=())
    users_to_aggregate: tuple[str, ...] = field(default=())
    #: Days that usage may lie before or after the day of its log, for tables with a ``day``; all days are read if None.
    day_margin: int | None = None

    def __post_init__(self):
        for name in ("cluster", "metric", "start_ms", "end_ms", "unit", "zone"):
            if getattr(self, name) in (None, ""):
                raise ValueError(f"missing: {name}")
        if self.unit not in timefn.UNITS:
            raise ValueError(f"unit must be one of {timefn.UNITS}: {self.unit}")
        metrics.measure(self.metric)
        if not self.users and not self.users_to_aggregate:
            raise ValueError("missing: users")


def parse_users(text: str | None) -> tuple[str, ...]:
    """Comma-separated names, in order, each once."""
    return tuple(dict.fromkeys(u for u in (text or "").split(",") if u))


def clusters(usage: DataFrame) -> DataFrame:
    return usage.select("cluster").distinct().orderBy("cluster")


def users(usage: DataFrame, cluster: str) -> DataFrame:
    return usage.filter(F.col("cluster") == cluster).select("user").distinct().orderBy("user")


def time_range(usage: DataFrame, cluster: str) -> DataFrame:
    return usage.filter(F.col("cluster") == cluster).agg(F.min("time_ms").alias("lo_ms"), F.max("time_ms").alias("hi_ms"))


def aggregate(usage: DataFrame, keys: list[str], where: dict[str, object] | None = None, unit: str | None = None, zone: str = "UTC", measures: tuple[str, ...] = metrics.MEASURES) -> DataFrame:
    """Sums of the measures by keys and, if a unit is given, bucket."""
    rows = usage.filter(metrics.equal_all((where or {}).items()))
    if unit:
        rows = rows.withColumn("time_ms", timefn.bucket(F.col("time_ms"), unit, zone))
    return rows.groupBy(*keys, *(["time_ms"] if unit else [])).agg(*(F.sum(m).alias(m) for m in measures))


def axis_for(usage: DataFrame, r: Request) -> DataFrame:
    bounds = time_range(usage, r.cluster).crossJoin(timefn.request(usage.sparkSession, r.start_ms, r.end_ms))  # one row each
    return timefn.axis(bounds, r.unit, r.zone)


#: No bucket is longer than a quarter, 92 days and an hour at most.
_MARGIN_MS = 93 * 86_400_000


def _matching(usage: DataFrame, r: Request) -> DataFrame:
    """Rows of the metric with their bucket; a quarter's margin on both ends holds the buckets that the axis may show."""
    rows = usage.filter((F.col("cluster") == r.cluster) & metrics.predicate(r.metric))
    a, b = r.start_ms - _MARGIN_MS, r.end_ms + _MARGIN_MS
    if r.day_margin is not None and "day" in usage.columns:
        days = [dt.datetime.fromtimestamp(max(0, ms) / 1000, dt.timezone.utc) + dt.timedelta(days=k) for ms, k in ((a, -r.day_margin), (b, r.day_margin))]
        rows = rows.filter(F.col("day").between(*(d.strftime("%Y%m%d") for d in days)))
    return rows.filter(F.col("time_ms").between(a, b)).withColumn("time_ms", timefn.bucket(F.col("time_ms"), r.unit, r.zone))


def _sums(usage: DataFrame, r: Request, names: list[str]) -> DataFrame:
    return _matching(usage, r).filter(F.col("user").isin(names)).groupBy("user", "time_ms").agg(F.sum(metrics.measure(r.metric)).alias("value"))


def per_user(usage: DataFrame, r: Request) -> DataFrame:
    """(user, position, time_ms, value), a row for each requested user and period, zero where there is nothing."""
    names = list(dict.fromkeys(r.users))
    listed = F.posexplode(F.array(*(F.lit(u) for u in names))).alias("position", "user")
    grid = axis_for(usage, r).select("time_ms", listed)
    return grid.join(_sums(usage, r, names), ["user", "time_ms"], "left").select("user", "position", "time_ms", F.coalesce("value", metrics.zero(r.metric)).alias("value"))


def aggregated(usage: DataFrame, r: Request) -> DataFrame:
    """(time_ms, value) over users_to_aggregate, dense."""
    sums = _matching(usage, r).filter(F.col("user").isin(list(r.users_to_aggregate))).groupBy("time_ms").agg(F.sum(metrics.measure(r.metric)).alias("value"))
    return axis_for(usage, r).join(sums, "time_ms", "left").select("time_ms", F.coalesce("value", metrics.zero(r.metric)).alias("value"))


def complement(usage: DataFrame, cluster: str, selected: list[str]) -> DataFrame:
    """Users of the cluster that are not selected."""
    return users(usage, cluster).filter(~F.col("user").isin(list(selected)))


def response(usage: DataFrame, r: Request) -> str:
    """The result as JSON: times, a list of values for each user, and the aggregate.

    Two passes: one for the range of the data, one for the sums of all users named. To
    the driver come the periods shown and a row for each of them and named user.
    """
    times = [x.time_ms for x in axis_for(usage, r).orderBy("time_ms").collect()]
    zero = 0.0 if metrics.in_minutes(r.metric) else 0
    held: dict[tuple[str, int], float | int] = {}
    if times:
        rows = _sums(usage, r, list(dict.fromkeys((*r.users, *r.users_to_aggregate)))).filter(F.col("time_ms").between(times[0], times[-1]))
        held = {(x.user, x.time_ms): x.value for x in rows.collect() if x.value is not None}
    out: dict = {"cluster": r.cluster, "times": times, "users": [{"user": u, "data": [held.get((u, t), zero) for t in times]} for u in dict.fromkeys(r.users)]}
    if r.users_to_aggregate:
        names = set(r.users_to_aggregate)
        out["users_aggregated"] = [sum((held.get((u, t), zero) for u in sorted(names)), zero) for t in times]
        out["num_aggregated_users"] = len(names)
    return json.dumps(out)
