"""Hand-made frames shared by the tests."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd

RAW_SCHEMA = (
    "invoice_no string, stock_code string, description string, quantity string, "
    "invoice_date string, unit_price string, customer_id string, country string, "
    "source_sheet string"
)


def raw_frame(spark):
    """Text lines that reach every cleaning rule."""
    rows = [
        (" A1 ", " 10001a ", " Mug ", "2", "2011-01-05 10:00:00", "1.50", "7", " France ", "one"),
        (" A1 ", " 10001a ", " Mug ", "2", "2011-01-05 10:00:00", "1.50", "7", " France ", "one"),
        (" A1 ", " 10001a ", " Mug ", "2", "2011-01-05 10:00:00", "1.50", "7", " France ", "two"),
        ("cA2", "10002", "Cup", "-1", "2011-01-06 11:00:00", "4.00", "7", "France", "one"),
        ("A3", "post", "Postage", "1", "2011-02-01 09:00:00", "3.00", "8", "Spain", "one"),
        ("A4", "10003", None, "5", "2011-02-02 09:00:00", "0", "8", "Spain", "one"),
        ("A5", "10004", "Pan", "3", "2011-02-03 09:00:00", "2.00", None, "Spain", "one"),
        ("A6", "10004", "Pan", "three", "2011-02-03 09:00:00", "2.00", "9", "Spain", "one"),
        ("A7", "10004", "Pan", "3", "not a date", "2.00", "9", "Spain", "one"),
        ("A8", "10004", "Pan", "3", "2011-03-03 09:00:00", "2.00", "nine", None, "one"),
        ("A9", "10004", "Pan", "3", "2011-03-04 09:00:00", "2.00", "9", None, "one"),
    ]
    return spark.createDataFrame(rows, RAW_SCHEMA)


CURATED_SCHEMA = (
    "customer_id long, invoice_no string, invoice_date timestamp_ntz, stock_code string, "
    "quantity double, unit_price double, line_revenue double, is_cancellation boolean, "
    "return_value double, country_grouped string, invoice_month string"
)


def curated_rows(rows):
    """(customer, invoice, date text, code, quantity, price[, country]) to curated tuples."""
    result = []
    for customer, invoice, date, code, quantity, price, *country in rows:
        moment = datetime.fromisoformat(date)
        revenue = quantity * price
        cancelled = invoice.startswith("C")
        result.append(
            (
                customer, invoice, moment, code, float(quantity), float(price), float(revenue),
                cancelled, -revenue if cancelled else 0.0, country[0] if country else "France",
                moment.strftime("%Y-%m"),
            )
        )
    return result


def curated_frame(spark, rows):
    return spark.createDataFrame(curated_rows(rows), CURATED_SCHEMA)


def random_lines(seed: int, customers: int = 25, lines: int = 1500, hot_share: float = 0.35):
    """Random curated lines; customer 1 holds ``hot_share`` of them. Some invoices have
    lines at several moments, some days have several invoices."""
    rng = np.random.default_rng(seed)
    rows = []
    for number in range(lines):
        customer = 1 if rng.random() < hot_share else int(rng.integers(2, customers + 1))
        order = int(rng.integers(0, 12 if customer != 1 else 200))
        start = pd.Timestamp("2010-01-01") + pd.Timedelta(
            minutes=int((customer * 7919 + order * 104729) % (540 * 1440))
        )
        moment = start + pd.Timedelta(minutes=int(rng.integers(0, 3)) * int(rng.integers(0, 700)))
        cancelled = rng.random() < 0.15
        rows.append(
            (
                customer,
                f"{'C' if cancelled else ''}{customer}-{order}",
                moment.isoformat(sep=" "),
                f"{10000 + int(rng.integers(0, 40))}",
                int(rng.integers(1, 9)) * (-1 if cancelled else 1),
                round(float(rng.uniform(0.5, 30)), 2),
                ["France", "Spain", "Other"][int(rng.integers(0, 3))],
            )
        )
    return rows


def collected(df, *order):
    ordered = df.orderBy(*order) if order else df
    return [r.asDict() for r in ordered.collect()]


def only(df) -> dict:
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()

