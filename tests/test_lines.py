"""Sources, cleaning, quality reports and curation on hand-made lines."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.frames import collected, only, raw_frame
from tideline.operators import cleaning, curation, quality
from tideline.params import CleaningParams, CurationParams, QualityExpectations
from tideline.sources import loaders, sinks


def test_headers_and_stacking(spark, tmp_path):
    first = spark.createDataFrame([(1, "x")], "`Customer ID` long, ` Stock-Code` string")
    second = spark.createDataFrame([(2, 3.5)], "CustomerID long, Price double")
    rows = collected(loaders.load_raw({"a": first, "b": second}), "customer_id")
    assert rows == [
        {"customer_id": 1, "stock_code": "x", "source_sheet": "a", "unit_price": None},
        {"customer_id": 2, "stock_code": None, "source_sheet": "b", "unit_price": 3.5},
    ]
    second.write.option("header", True).csv(str(tmp_path / "s"))
    read = loaders.load_raw_files(spark, {"c": str(tmp_path / "s")}, "csv")
    assert collected(read, "customer_id") == [
        {"customer_id": "2", "unit_price": "3.5", "source_sheet": "c"}
    ]


def test_schema_guard(spark):
    with pytest.raises(ValueError, match="country"):
        loaders.require_columns(raw_frame(spark).drop("country"))
    extra = raw_frame(spark).withColumn("other", F.lit(1))
    assert "other" not in loaders.require_columns(extra).columns


def test_cleaning(spark):
    rows = collected(
        cleaning.clean_transactions(raw_frame(spark)), "invoice_no", "source_sheet", "stock_code"
    )
    # The duplicate inside one source goes, the one across sources stays; postage, anonymous
    # and unreadable lines go.
    assert [(r["invoice_no"], r["source_sheet"]) for r in rows] == [
        ("A1", "one"), ("A1", "two"), ("A4", "one"), ("A9", "one"), ("cA2", "one"),
    ]
    assert rows[0]["stock_code"] == "10001A" and rows[0]["country"] == "France"
    assert rows[0]["line_revenue"] == 3.0 and rows[0]["invoice_month"] == "2011-01"
    cancelled = rows[-1]
    assert cancelled["is_cancellation"] and cancelled["is_return"]
    assert cancelled["line_revenue"] == -4.0 and cancelled["customer_id"] == 7


def test_cleaning_options(spark):
    keep = CleaningParams(drop_missing_customer=False, drop_non_product=False)
    rows = collected(cleaning.clean_transactions(raw_frame(spark), keep), "invoice_no")
    by_invoice = {r["invoice_no"]: r for r in rows}
    assert by_invoice["A3"]["is_non_product"] and by_invoice["A5"]["customer_id"] is None
    assert by_invoice["A8"]["customer_id"] is None
    merged = CleaningParams(dedup_ignores_source=True, non_product_codes=("10003", "post"))
    rows = collected(cleaning.clean_transactions(raw_frame(spark), merged), "invoice_no")
    assert [r["invoice_no"] for r in rows] == ["A1", "A9", "cA2"]


def test_quality_report(spark):
    clean = cleaning.clean_transactions(raw_frame(spark))
    report = only(quality.dq_report(clean, QualityExpectations("2011-01-06", "2011-03-01")))
    assert report["passed"] and report["n_rows"] == 5 and report["n_customers"] == 3
    assert report["n_cancellations"] == 1
    assert report["total_net_revenue"] == 8.0 and report["gross_revenue"] == 12.0
    assert [i["message"] for i in report["issues"]] == [
        "Earliest invoice 2011-01-05 precedes 2011-01-06",
        "Latest invoice 2011-03-04 is after 2011-03-01",
    ]


def test_quality_report_failures(spark):
    clean = cleaning.clean_transactions(raw_frame(spark))
    empty = only(quality.dq_report(clean.limit(0)))
    assert not empty["passed"] and empty["n_rows"] == 0 and empty["total_net_revenue"] == 0.0
    partial = only(quality.dq_report(clean.drop("country", "customer_id")))
    messages = [i["message"] for i in partial["issues"]]
    assert messages[:2] == [
        "Missing required column: customer_id", "Missing required column: country",
    ]
    nulled = clean.withColumn("customer_id", F.when(F.col("invoice_no") != "A4", F.col("customer_id")))
    found = collected(quality.explode_issues(quality.dq_report(nulled)), "message")
    assert found[-1] == {
        "level": "error", "message": "Null customer_id values present after cleaning",
    }
    one = only(quality.dq_report(clean.filter("customer_id = 7")))
    assert one["issues"][0]["message"] == "Fewer than two unique customers in the dataset"


def test_monthly_summary(spark):
    clean = cleaning.clean_transactions(raw_frame(spark))
    rows = collected(quality.monthly_summary(clean), "invoice_month")
    assert [r["invoice_month"] for r in rows] == ["2011-01", "2011-02", "2011-03"]
    assert rows[0]["n_transaction_lines"] == 3 and rows[0]["n_orders"] == 2
    assert rows[0]["n_cancellations"] == 1 and rows[0]["net_revenue"] == 2.0
    assert sum(r["net_revenue"] for r in rows) == 8.0


def test_curation(spark):
    clean = cleaning.clean_transactions(raw_frame(spark))
    params = CurationParams(
        residual_admin_codes=("10003",), lower_quantile=0.0, upper_quantile=0.75,
        min_lines_per_country=3,
    )
    rows = collected(curation.curate_transactions(clean, params), "invoice_no", "source_sheet")
    assert [r["invoice_no"] for r in rows] == ["A1", "A1", "A9", "cA2"]
    cancelled, ninth = rows[3], rows[2]
    assert cancelled["line_revenue_gross"] == 0.0 and cancelled["return_value"] == 4.0
    assert not cancelled["is_monetary_eligible"]
    # Quantities -1, 2, 2, 3: the upper cut is 2.25.
    assert ninth["quantity_winsorised"] == 2.25 and ninth["is_outlier"]
    assert ninth["country_grouped"] == "Other" and cancelled["country_grouped"] == "France"


def test_curated_report(spark):
    clean = cleaning.clean_transactions(raw_frame(spark))
    curated = curation.curate_transactions(clean)
    report = only(quality.curated_dq_report(curated))
    assert report["passed"] and report["n_zero_price_lines"] == 1
    assert report["issues"][0]["level"] == "info"
    broken = curated.withColumn(
        "stock_code", F.when(F.col("invoice_no") == "A9", "BAD!!").otherwise(F.col("stock_code"))
    ).withColumn("unit_price", F.when(F.col("invoice_no") == "A4", -1.0).otherwise(F.col("unit_price")))
    report = only(quality.curated_dq_report(broken))
    messages = [i["message"] for i in report["issues"]]
    assert messages[0] == "1 stock codes fail format ^[0-9]{5}[A-Z]{0,3}$: ['BAD!!']"
    assert messages[1] == "1 rows have negative unit_price" and not report["passed"]
    absent = only(quality.curated_dq_report(curated.drop("is_outlier")))
    assert absent["issues"][0]["message"] == "Missing curated columns: ['is_outlier']"


def test_sinks(spark, tmp_path):
    clean = cleaning.clean_transactions(raw_frame(spark))
    table = sinks.write_table(clean, str(tmp_path / "t"), ["invoice_month"])
    assert table.count() == 5 and set(table.columns) == set(clean.columns)
    report = quality.dq_report(clean)
    sinks.write_report(report, str(tmp_path / "r"))
    assert '"n_rows":5' in spark.read.text(str(tmp_path / "r")).head()[0]
