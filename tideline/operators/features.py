"""Customer features and churn labels for one or many cutoff dates in one pass.

Lines are shrunk once to an invoice rollup. Every cutoff and every end of a
performance window is a breakpoint; a line's ``slot`` is the number of
breakpoints before it, so "dated on or before T" is ``slot <= index of T``. The
rollup keeps the slot, which makes it exact for all cutoffs at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.ordering import counted_quantiles, quantiles
from tideline.functions.scalars import (
    as_timestamp,
    elapsed_days,
    finite,
    fractional_days,
    money_sum,
    money_total,
    safe_ratio,
)
from tideline.params import DAYS_PER_MONTH, TemporalParams
from tideline.session import materialise

KEYS = ("cohort_date", "customer_id")
HELPER_COLUMNS = (
    "n_lines",
    "aov_last_90",
    "aov_prev_90",
    "recent_order_rate",
    "recent_revenue_rate",
    "tenure_months",
    "orders_prev_90",
    "median_interval",
    "max_interval",
    "first_order_date",
    "last_order_date",
)


@dataclass(frozen=True)
class Cutoffs:
    """Cutoff dates with their performance windows as breakpoints on the time line."""

    dates: tuple[str, ...]
    horizon_days: int

    def _ends(self) -> list[str]:
        shift = timedelta(days=self.horizon_days)
        return [(datetime.fromisoformat(d) + shift).isoformat(" ") for d in self._starts()]

    def _starts(self) -> list[str]:
        return [datetime.fromisoformat(d).isoformat(" ") for d in self.dates]

    def breakpoints(self) -> list[str]:
        return sorted({*self._starts(), *self._ends()})

    def slot(self, date: Column) -> Column:
        """Number of breakpoints strictly before the date."""
        return reduce(
            lambda a, b: a + b,
            [(date > as_timestamp(b)).cast("int") for b in self.breakpoints()],
        )

    def seen(self) -> list[int]:
        """The last slot that each cohort observes."""
        order = self.breakpoints()
        return [order.index(start) for start in self._starts()]

    def latest(self) -> str:
        return max(self._starts())

    def days_back(self) -> list[int] | None:
        """Days from each cutoff to the latest one; None where that is not a whole number."""
        back = [datetime.fromisoformat(self.latest()) - datetime.fromisoformat(d) for d in self._starts()]
        return None if any(b % timedelta(days=1) for b in back) else [b.days for b in back]

    def per_cohort(self, fields: Sequence[dict[str, Column]]) -> Column:
        """Array of (cohort_date, further fields of each cohort)."""
        return F.array(
            *[
                F.struct(as_timestamp(start).alias("cohort_date"), *[v.alias(k) for k, v in more.items()])
                for start, more in zip(self._starts(), fields)
            ]
        )

    def cohorts(self) -> Column:
        """Array of (cohort_date, last slot observed, last slot of the performance window)."""
        order = self.breakpoints()
        return F.array(
            *[
                F.struct(
                    as_timestamp(start).alias("cohort_date"),
                    F.lit(order.index(start)).alias("seen"),
                    F.lit(order.index(end)).alias("until"),
                )
                for start, end in zip(self._starts(), self._ends())
            ]
        )


def observation_window(tx: DataFrame, cutoff: str) -> DataFrame:
    return tx.filter(F.col("invoice_date") <= as_timestamp(cutoff))


def performance_window(tx: DataFrame, cutoff: str, horizon_days: int) -> DataFrame:
    start = as_timestamp(cutoff)
    date = F.col("invoice_date")
    return tx.filter((date > start) & (date <= start + F.make_dt_interval(F.lit(horizon_days))))


def eligible_customers(tx: DataFrame, cutoff: str) -> DataFrame:
    bought = observation_window(tx, cutoff).filter(~F.col("is_cancellation"))
    return bought.filter(F.col("customer_id").isNotNull()).select("customer_id").distinct()


def split_purchase_cancel(tx: DataFrame) -> DataFrame:
    """Lines, revenue and units of purchases and of cancellations per customer."""
    cancelled = F.col("is_cancellation")
    return tx.groupBy("customer_id").agg(
        F.count_if(~cancelled).alias("purchase_lines"),
        F.count_if(cancelled).alias("cancelled_lines"),
        money_sum(F.when(~cancelled, F.col("line_revenue"))).alias("purchase_revenue"),
        money_sum(F.when(cancelled, F.col("return_value"))).alias("returned_value"),
    )


def invoice_rollup(
    curated: DataFrame, cutoffs: Cutoffs, params: TemporalParams = TemporalParams()
) -> DataFrame:
    """About one row per invoice, split where its lines differ in slot, month or country."""
    last = as_timestamp(cutoffs.breakpoints()[-1])
    lines = curated.filter((F.col("invoice_date") <= last) & F.col("customer_id").isNotNull())
    if params.eligible_lines_only:
        lines = lines.filter(F.col("is_cancellation") | F.col("is_monetary_eligible"))
    return (
        lines.withColumn("slot", cutoffs.slot(F.col("invoice_date")))
        .groupBy(
            "customer_id",
            "invoice_no",
            "is_cancellation",
            "invoice_month",
            "country_grouped",
            "slot",
        )
        .agg(
            F.min("invoice_date").alias("first_date"),
            money_sum(F.col(params.revenue_column)).alias("revenue"),
            # Observed future revenue is always the uncapped one.
            money_sum(F.col("line_revenue")).alias("plain_revenue"),
            money_sum(F.col("return_value")).alias("return_value"),
            F.count(F.lit(1)).alias("lines"),
            F.sum("quantity").alias("quantity"),
        )
    )


def _per_cohort(rollup: DataFrame, cutoffs: Cutoffs, include_future: bool = False) -> DataFrame:
    """Repeat each row for the cohorts that see it; ``seen`` is the cohort's last slot."""
    edge = "until" if include_future else "seen"
    reached = F.filter(cutoffs.cohorts(), lambda c: F.col("slot") <= c[edge])
    return (
        rollup.withColumn("_cohort", F.explode(reached))
        .withColumn("cohort_date", F.col("_cohort.cohort_date"))
        .withColumn("seen", F.col("_cohort.seen"))
        .withColumn("observed", F.col("slot") <= F.col("seen"))
        .drop("_cohort")
    )


PARTS = ("slot", "first_date", "revenue", "lines", "quantity")


def orders_once(rollup: DataFrame) -> DataFrame:
    """One row per purchase invoice, whatever the number of cohorts.

    Lines of one invoice may lie in several slots, so it keeps what it has per slot: ``parts``,
    hardly ever more than one. Rows of a customer are brought together (a customer with very many
    over several tasks), so that aggregates by customer and cohort combine before they shuffle.
    """
    return (
        rollup.filter(~F.col("is_cancellation"))
        .groupBy("customer_id", "invoice_no")
        .agg(F.collect_list(F.struct(*PARTS)).alias("parts"), F.min("slot").alias("slot"))
        .hint("rebalance", "customer_id")
    )


def seen_orders(once: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """Each invoice as each cohort sees it: a map over ``once`` that is never written."""
    parts = F.filter("parts", lambda p: p["slot"] <= F.col("seen"))
    kinds = {f.name: f.dataType for f in once.schema["parts"].dataType.elementType.fields}

    def whole(name: str) -> Column:
        known = F.filter("_parts", lambda p: p[name].isNotNull())
        total = F.aggregate(known, F.lit(0).cast(kinds[name]), lambda s, p: s + p[name])
        return F.when(F.size(known) > 0, total)

    return (
        _per_cohort(once, cutoffs)
        .withColumn("_parts", parts)
        .select(
            *KEYS,
            "invoice_no",
            F.array_min(F.transform("_parts", lambda p: p["first_date"])).alias("order_date"),
            money_total("_parts", "revenue").alias("order_revenue"),
            whole("lines").alias("order_lines"),
            whole("quantity").alias("order_quantity"),
        )
    )


def order_rollup(rollup: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """One row per purchase invoice as each cohort sees it."""
    return seen_orders(orders_once(rollup), cutoffs)


def _in_last(days: int) -> Column:
    """Strictly inside the last ``days`` days: an order ``days`` old is out."""
    return F.col("age_days") < days


def with_age(orders: DataFrame) -> DataFrame:
    return orders.withColumn("age_days", elapsed_days(F.col("order_date"), F.col("cohort_date")))


def _aggregate(orders: DataFrame, *aggregates: Column) -> DataFrame:
    return with_age(orders).groupBy(*KEYS).agg(*aggregates)


def _revenue_when(condition: Column) -> Column:
    return F.coalesce(money_sum(F.when(condition, F.col("order_revenue"))), F.lit(0.0))


def _rfm_aggregates() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_orders"),
        money_sum(F.col("order_revenue")).alias("gross_revenue"),
        F.max("order_revenue").alias("max_order_value"),
        F.coalesce(F.stddev_samp("order_revenue"), F.lit(0.0)).alias("std_order_value"),
        F.sum("order_lines").alias("total_lines"),
        F.sum("order_quantity").alias("total_quantity"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        (money_sum(F.col("order_revenue")) / F.count(F.lit(1))).alias("aov"),
        F.avg("order_lines").alias("avg_basket_lines"),
    ]


def _window_aggregates(windows: Sequence[int]) -> list[Column]:
    counts = [F.count_if(_in_last(d)).alias(f"n_orders_{d}") for d in windows]
    return counts + [_revenue_when(_in_last(d)).alias(f"revenue_{d}") for d in windows]


def _previous_aggregates() -> list[Column]:
    inside = _in_last(180) & ~_in_last(90)
    return [
        F.count_if(inside).alias("orders_prev_90"),
        _revenue_when(inside).alias("revenue_prev_90"),
    ]


def _trend_aggregate() -> Column:
    day = -fractional_days(F.col("order_date"), F.col("cohort_date"))
    slope = F.regr_slope("order_revenue", day)
    return F.coalesce(slope, F.lit(0.0)).alias("revenue_trend_slope")


def rfm_core(orders: DataFrame) -> DataFrame:
    """Recency, frequency and value aggregates per customer (all but the median)."""
    return _aggregate(orders, *_rfm_aggregates())


def median_order_value(orders: DataFrame) -> DataFrame:
    return quantiles(orders, "order_revenue", {"median_order_value": 0.5}, by=KEYS)


def cohort_medians(once: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """``median_order_value`` of every cohort, without a row per order and cohort.

    An order has one value from each slot of its parts up to the next. These are counted per
    customer and value, with one count for each cohort, and laid out once for all cohorts.
    """
    seen = cutoffs.seen()
    slots = F.array_distinct(F.transform("parts", lambda p: p["slot"]))
    states = (
        once.filter(F.col("slot") <= max(seen))
        .withColumn("_slots", slots)
        .withColumn("_from", F.explode("_slots"))
        .withColumn("_next", F.array_min(F.filter("_slots", lambda s: s > F.col("_from"))))
        .withColumn("_parts", F.filter("parts", lambda p: p["slot"] <= F.col("_from")))
        .select("customer_id", "_from", "_next", money_total("_parts", "revenue").alias("order_revenue"))
    )
    before_next = F.coalesce("_next", F.lit(max(seen) + 1))
    counts = {f"_n{i}": (F.col("_from") <= s) & (s < before_next) for i, s in enumerate(seen)}
    counted = (
        states.filter(F.col("order_revenue").isNotNull())
        .groupBy("customer_id", "order_revenue")
        .agg(*[F.count_if(holds).alias(name) for name, holds in counts.items()])
    )
    found = counted_quantiles(counted, "order_revenue", list(counts), 0.5, ["customer_id"])
    entries = cutoffs.per_cohort([{"median_order_value": F.col(name)} for name in counts])
    known = F.filter(entries, lambda c: c["median_order_value"].isNotNull())
    return found.select("customer_id", F.inline(known)).select(*KEYS, "median_order_value")


def rolling_windows(
    orders: DataFrame, windows: Sequence[int] = TemporalParams.recent_windows
) -> DataFrame:
    """Orders and revenue in the last W days, every W in one aggregate."""
    return _aggregate(orders, *_window_aggregates(windows))


def previous_window(orders: DataFrame) -> DataFrame:
    """Orders and revenue 90 to 180 days before the cutoff."""
    return _aggregate(orders, *_previous_aggregates())


def order_value_trend(orders: DataFrame) -> DataFrame:
    """Least-squares slope of order value per day; 0 without spread in time."""
    return _aggregate(orders, _trend_aggregate())


def purchase_days(orders: DataFrame) -> DataFrame:
    """Orders per 24-hour period before the cutoff, with the gap to the period before.

    Orders less than a day apart have interval 0, so a period with n orders holds
    n - 1 zeros and one gap. A customer has no more periods than the history has
    days, whatever the number of orders, so the window below stays small.
    """
    along = W.partitionBy(*KEYS).orderBy("first_at")
    before = along.rowsBetween(W.unboundedPreceding, -1)
    return (
        with_age(orders)
        .groupBy(*KEYS, "age_days")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.min("order_date").alias("first_at"),
            F.max("order_date").alias("last_at"),
        )
        .withColumn("gap", elapsed_days(F.lag("last_at").over(along), F.col("first_at")))
        .withColumn("orders_before", F.coalesce(F.sum("orders").over(before), F.lit(0)))
        .withColumn(
            "all_orders", F.sum("orders").over(W.partitionBy(*KEYS))
        )
    )


def cohort_purchase_days(once: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """``purchase_days`` of every cohort, from one window per customer.

    Cutoffs that are whole days apart cut time into the same 24-hour periods: a cohort sees a
    period as a whole or not at all, and what lies before it is the same for all that see it.
    """
    back = cutoffs.days_back()
    if back is None:
        return purchase_days(seen_orders(once, cutoffs))
    along = W.partitionBy("customer_id").orderBy("first_at")
    before = along.rowsBetween(W.unboundedPreceding, -1)
    # The first lines of an invoice are in its first slot, which every cohort that sees it sees.
    date = F.array_min(F.transform("parts", lambda p: p["first_date"]))
    whole = W.partitionBy("customer_id")
    seen = [F.col("_age") >= days for days in back]
    entries = cutoffs.per_cohort(
        [
            {"observed": s, "all_orders": F.sum(F.when(s, F.col("orders"))).over(whole)}
            for s in seen
        ]
    )
    return (
        once.filter(F.col("slot") <= max(cutoffs.seen()))
        .select("customer_id", date.alias("order_date"))
        .withColumn("_age", elapsed_days(F.col("order_date"), as_timestamp(cutoffs.latest())))
        .groupBy("customer_id", "_age")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.min("order_date").alias("first_at"),
            F.max("order_date").alias("last_at"),
        )
        .withColumn("gap", elapsed_days(F.lag("last_at").over(along), F.col("first_at")))
        .withColumn("orders_before", F.coalesce(F.sum("orders").over(before), F.lit(0)))
        .withColumn("_cohorts", entries)
        .withColumn("_cohort", F.explode(F.filter("_cohorts", lambda c: c["observed"])))
        .select(
            *[F.col(f"_cohort.{name}").alias(name) for name in ("cohort_date", "all_orders")],
            *["customer_id", "orders", "first_at", "last_at", "gap", "orders_before"],
        )
    )


def interval_lag(orders: DataFrame) -> DataFrame:
    """Previous and current purchase day with the days between their closest orders."""
    along = W.partitionBy(*KEYS).orderBy("first_at")
    return purchase_days(orders).select(
        *KEYS,
        "first_at",
        F.lag("last_at").over(along).alias("previous_order_date"),
        F.col("gap").alias("interval_days"),
        (F.col("orders") - 1).alias("same_day_intervals"),
    )


def interval_stats(orders: DataFrame) -> DataFrame:
    """Interval mean, deviation, median, maximum, latest value and change.

    The change is the mean of the later intervals minus that of the earlier half
    (rounded down). The gap of a period is the interval number ``orders_before - 1``.
    """
    return interval_aggregates(purchase_days(orders))


def interval_aggregates(days: DataFrame) -> DataFrame:
    """``interval_stats`` from what ``purchase_days`` gives."""
    count = F.col("all_orders") - 1
    half = F.floor(count / 2)
    gap, zero = F.col("gap"), F.lit(0).cast("int")
    earlier = F.col("orders_before") - 1 < half
    # A period is one gap and orders - 1 zeros: both as value and frequency.
    parts = days.withColumn(
        "_part",
        F.explode(
            F.array(
                F.struct(gap.alias("value"), gap.isNotNull().cast("long").alias("n")),
                F.struct(zero.alias("value"), (F.col("orders") - 1).alias("n")),
            )
        ),
    ).select("*", "_part.value", "_part.n")
    total = F.sum(F.when(F.col("n") > 0, F.col("value") * F.col("n")))
    squares = F.sum(F.when(F.col("n") > 0, F.col("value") * F.col("value") * F.col("n")))
    intervals = F.max(count)
    mean = F.try_divide(total, intervals)
    spread = squares - F.try_divide(total * total, intervals)
    deviation = F.sqrt(F.greatest(F.try_divide(spread, intervals - 1), F.lit(0.0)))
    older = F.try_divide(
        F.coalesce(F.sum(F.when(earlier, F.col("value") * F.col("n"))), F.lit(0)), F.max(half)
    )
    newer = F.try_divide(
        F.coalesce(F.sum(F.when(~earlier, F.col("value") * F.col("n"))), F.lit(0)),
        F.max(count - half),
    )
    last = F.max_by(F.when(F.col("orders") > 1, 0).otherwise(gap), F.col("first_at"))
    return parts.groupBy(*KEYS).agg(
        mean.alias("avg_interval"),
        F.coalesce(deviation, F.lit(0.0)).alias("std_interval"),
        F.percentile(F.when(F.col("n") > 0, F.col("value")), 0.5, F.col("n")).alias(
            "median_interval"
        ),
        F.max(F.when(F.col("n") > 0, F.col("value"))).alias("max_interval"),
        last.alias("days_since_previous_purchase"),
        F.when(intervals >= 2, newer - older).otherwise(F.lit(0.0)).alias("interval_change"),
    )


def product_signals(
    curated: DataFrame, cutoffs: Cutoffs, params: TemporalParams = TemporalParams()
) -> DataFrame:
    """Distinct products bought: a product counts from the first slot it appears in."""
    bought = observation_window(curated, max(cutoffs.dates)).filter(~F.col("is_cancellation"))
    if params.eligible_lines_only:
        bought = bought.filter("is_monetary_eligible")
    first = (
        bought.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id", "stock_code")
        .agg(F.min("invoice_date").alias("first_date"))
        .withColumn("slot", cutoffs.slot(F.col("first_date")))
    )
    return _counted_from(first, cutoffs, "stock_code", "n_unique_products")


def _counted_from(first: DataFrame, cutoffs: Cutoffs, column: str, name: str) -> DataFrame:
    """Values of ``column`` that each cohort sees; ``first`` has them by customer with the first
    ``slot`` of each. Customers are counted for all cohorts at once."""
    seen = cutoffs.seen()
    known = F.col(column).isNotNull()
    counted = first.groupBy("customer_id").agg(
        F.min("slot").alias("_first"),
        *[F.count_if((F.col("slot") <= s) & known).alias(f"_n{i}") for i, s in enumerate(seen)],
    )
    entries = cutoffs.per_cohort(
        [{"observed": F.col("_first") <= s, name: F.col(f"_n{i}")} for i, s in enumerate(seen)]
    )
    cohorts = F.filter(entries, lambda c: c["observed"])
    return counted.select("customer_id", F.inline(cohorts)).select(*KEYS, name)


def return_signals(rollup: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """Cancelled invoices and their value; a customer is counted for all cohorts at once."""
    seen = cutoffs.seen()
    values = [f"_value{i}" for i in range(len(seen))]
    cancelled = (
        rollup.filter("is_cancellation")
        .groupBy("customer_id", "invoice_no")
        .agg(
            F.min("slot").alias("slot"),
            *[F.sum(F.when(F.col("slot") <= s, F.col("return_value"))).alias(v) for v, s in zip(values, seen)],
        )
    )
    counted = cancelled.groupBy("customer_id").agg(
        *[F.count_if(F.col("slot") <= s).alias(f"_n{i}") for i, s in enumerate(seen)],
        *[money_sum(F.col(v)).alias(v) for v in values],
    )
    entries = cutoffs.per_cohort(
        [
            {"n_cancel_orders": F.col(f"_n{i}"), "return_value": F.col(v)}
            for i, v in enumerate(values)
        ]
    )
    some = F.filter(entries, lambda c: c["n_cancel_orders"] > 0)
    return counted.select("customer_id", F.inline(some)).select(
        *KEYS, "n_cancel_orders", "return_value"
    )


def active_months(rollup: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    first = (
        rollup.filter(~F.col("is_cancellation"))
        .groupBy("customer_id", "invoice_month")
        .agg(F.min("slot").alias("slot"))
    )
    return _counted_from(first, cutoffs, "invoice_month", "active_months")


def modal_country(rollup: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """Most frequent country over purchase lines; the first in text order on a tie."""
    lines = (
        rollup.filter(~F.col("is_cancellation"))
        .groupBy("customer_id", "country_grouped", "slot")
        .agg(F.sum("lines").alias("lines"))
    )
    counted = (
        _per_cohort(lines, cutoffs).groupBy(*KEYS, "country_grouped").agg(F.sum("lines").alias("n"))
    )
    best = F.min_by("country_grouped", F.struct(-F.col("n"), F.col("country_grouped")))
    return counted.groupBy(*KEYS).agg(best.alias("country_grouped"))


def future_activity(rollup: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """Purchase invoices and their uncapped revenue inside each performance window."""
    reached = _per_cohort(rollup.filter(~F.col("is_cancellation")), cutoffs, include_future=True)
    return (
        reached.filter(~F.col("observed"))
        .groupBy(*KEYS, "invoice_no")
        .agg(F.sum("plain_revenue").alias("revenue"))
        .groupBy(*KEYS)
        .agg(
            F.count(F.lit(1)).alias("future_orders"),
            money_sum(F.col("revenue")).alias("future_revenue"),
        )
    )


def churn_labels(rollup: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """Future orders, future gross revenue and churn of every customer seen to buy."""
    eligible = (
        _per_cohort(rollup.filter(~F.col("is_cancellation")), cutoffs)
        .select(*KEYS)
        .distinct()
    )
    return _label(eligible.join(future_activity(rollup, cutoffs), list(KEYS), "left"))


def _label(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "future_orders": F.coalesce("future_orders", F.lit(0)),
            "future_revenue": F.coalesce("future_revenue", F.lit(0.0)),
        }
    ).withColumn("churn", (F.col("future_orders") == 0).cast("int"))


def feature_formulas(df: DataFrame) -> DataFrame:
    """Ratios, rates and growth figures from the joined aggregates."""
    c = F.col
    at_least_one = lambda name: F.greatest(c(name).cast("double"), F.lit(1.0))
    df = df.withColumns(
        {
            "tenure_days": elapsed_days(c("first_order_date"), c("cohort_date")),
            "recency_days": elapsed_days(c("last_order_date"), c("cohort_date")),
            "net_revenue": c("gross_revenue") - c("return_value"),
        }
    ).withColumn("tenure_months", F.greatest(c("tenure_days") / DAYS_PER_MONTH, F.lit(1.0)))
    df = df.withColumns(
        {
            "purchase_frequency": c("n_orders") / c("tenure_months"),
            "overall_order_rate": c("n_orders") / at_least_one("tenure_days"),
            "revenue_per_month": c("net_revenue") / c("tenure_months"),
            "return_value_ratio": safe_ratio(c("return_value"), c("gross_revenue")),
            "cancellation_rate": safe_ratio(
                c("n_cancel_orders"), c("n_orders") + c("n_cancel_orders")
            ),
            "avg_unit_price": safe_ratio(c("gross_revenue"), at_least_one("total_quantity")),
            "product_diversity": safe_ratio(c("n_unique_products"), at_least_one("total_lines")),
            "order_value_cv": safe_ratio(c("std_order_value"), c("aov")),
            "interval_cv": safe_ratio(c("std_interval"), c("avg_interval")),
            "is_single_purchase": (c("n_orders") == 1).cast("int"),
            "active_month_ratio": safe_ratio(c("active_months"), c("tenure_months")),
            "recent_order_share": safe_ratio(c("n_orders_90"), c("n_orders")),
            "recent_revenue_share": safe_ratio(c("revenue_90"), c("gross_revenue")),
            "recent_order_rate": c("n_orders_90") / 90.0,
            "recent_revenue_rate": c("revenue_90") / 90.0,
            "aov_last_90": safe_ratio(c("revenue_90"), c("n_orders_90")),
            "aov_prev_90": safe_ratio(c("revenue_prev_90"), c("orders_prev_90")),
        }
    )
    return df.withColumns(
        {
            "order_rate_ratio": safe_ratio(c("recent_order_rate"), c("overall_order_rate")),
            "revenue_rate_ratio": safe_ratio(
                c("recent_revenue_rate"), c("gross_revenue") / at_least_one("tenure_days")
            ),
            "revenue_growth_90": safe_ratio(
                c("revenue_90") - c("revenue_prev_90"), c("revenue_prev_90") + 1
            ),
            "order_growth_90": safe_ratio(
                c("n_orders_90") - c("orders_prev_90"), c("orders_prev_90") + 1
            ),
            "aov_change_90": safe_ratio(c("aov_last_90") - c("aov_prev_90"), c("aov_prev_90") + 1),
            "recency_to_interval_ratio": safe_ratio(
                c("recency_days"), F.coalesce(c("avg_interval"), c("tenure_days").cast("double"))
            ),
        }
    )


def fill_defaults(df: DataFrame) -> DataFrame:
    """Absent activity is 0; a missing interval stays null, a missing country is grouped."""
    zero = {c: 0.0 for c in ("return_value",)} | {c: 0 for c in ("n_cancel_orders",)}
    return df.fillna({**zero, "country_grouped": "Other"})


def inf_to_null(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: finite(F.col(c)) for c in doubles})


def drop_intermediates(df: DataFrame) -> DataFrame:
    return df.drop(*HELPER_COLUMNS)


def order_aggregates(orders: DataFrame, params: TemporalParams) -> DataFrame:
    """Everything one aggregate over the orders can give."""
    return _aggregate(
        orders,
        *_rfm_aggregates(),
        *_window_aggregates(params.recent_windows),
        *_previous_aggregates(),
        _trend_aggregate(),
    )


def assemble_features(
    curated: DataFrame,
    rollup: DataFrame,
    cutoffs: Cutoffs,
    params: TemporalParams = TemporalParams(),
) -> DataFrame:
    """Features per (cohort_date, customer_id); all joins share that key."""
    once = materialise(orders_once(rollup))
    orders = seen_orders(once, cutoffs)
    parts = [
        interval_aggregates(cohort_purchase_days(once, cutoffs)),
        cohort_medians(once, cutoffs),
        product_signals(curated, cutoffs, params),
        return_signals(rollup, cutoffs),
        active_months(rollup, cutoffs),
        modal_country(rollup, cutoffs),
    ]
    joined = order_aggregates(orders, params)
    for part in parts:
        joined = joined.join(part, list(KEYS), "left")
    return drop_intermediates(inf_to_null(feature_formulas(fill_defaults(joined))))


def customer_features(
    curated: DataFrame, params: TemporalParams = TemporalParams()
) -> DataFrame:
    """Feature store at one cutoff, one row per customer with a purchase by then."""
    cutoffs = Cutoffs((params.cutoff_date,), params.performance_window_days)
    seen = observation_window(curated, params.cutoff_date)
    rollup = materialise(invoice_rollup(seen, cutoffs, params))
    return assemble_features(seen, rollup, cutoffs, params).drop("cohort_date")


def customer_labels(curated: DataFrame, params: TemporalParams = TemporalParams()) -> DataFrame:
    """Churn labels at one cutoff, with the cutoff and the end of the window."""
    cutoffs = Cutoffs((params.cutoff_date,), params.performance_window_days)
    labels = churn_labels(invoice_rollup(curated, cutoffs, params), cutoffs)
    end = F.col("cohort_date") + F.make_dt_interval(F.lit(params.performance_window_days))
    return labels.select(
        "customer_id",
        "future_orders",
        "future_revenue",
        "churn",
        F.col("cohort_date").alias("cutoff_date"),
        end.alias("performance_end_date"),
    )


def cohort_panel(
    curated: DataFrame,
    cohort_dates: Sequence[str],
    params: TemporalParams = TemporalParams(),
) -> DataFrame:
    """Features and labels of every cohort, from one scan of the lines plus one for products."""
    cutoffs = Cutoffs(tuple(cohort_dates), params.performance_window_days)
    rollup = materialise(invoice_rollup(curated, cutoffs, params))
    features = assemble_features(curated, rollup, cutoffs, params)
    return _label(features.join(future_activity(rollup, cutoffs), list(KEYS), "left"))


def temporal_split(panel: DataFrame, cohort_dates: Sequence[str]) -> DataFrame:
    return panel.filter(F.col("cohort_date").isin([as_timestamp(d) for d in cohort_dates]))
