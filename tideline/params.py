"""Parameters of every stage, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# Names, code lists, thresholds and texts that results depend on.
REQUIRED_COLUMNS = (
    "invoice_no",
    "stock_code",
    "description",
    "quantity",
    "invoice_date",
    "unit_price",
    "customer_id",
    "country",
)
HEADER_NAMES = {
    "invoice": "invoice_no",
    "invoiceno": "invoice_no",
    "stockcode": "stock_code",
    "description": "description",
    "quantity": "quantity",
    "invoicedate": "invoice_date",
    "price": "unit_price",
    "unitprice": "unit_price",
    "customerid": "customer_id",
    "country": "country",
}
NON_PRODUCT_CODES = (
    "POST",
    "D",
    "M",
    "BANK CHARGES",
    "PADS",
    "DOT",
    "C2",
    "CRUK",
    "S",
    "AMAZONFEE",
    "B",
    "TEST",
)
RESIDUAL_ADMIN_CODES = ("ADJUST", "ADJUST2", "SP1002", "TEST001", "TEST002")
STOCK_CODE_PATTERN = r"^[0-9]{5}[A-Z]{0,3}$"
CLUSTER_FEATURES = (
    "recency_days",
    "n_orders",
    "net_revenue",
    "aov",
    "avg_interval",
    "n_unique_products",
    "return_value_ratio",
    "recent_revenue_share",
    "tenure_days",
    "product_diversity",
)
LOG_FEATURES = ("n_orders", "net_revenue", "aov", "n_unique_products", "tenure_days")
SURVIVAL_FEATURES = (
    "recency_days",
    "n_orders",
    "net_revenue",
    "aov",
    "return_value_ratio",
    "avg_interval",
)
STRATEGY_BY_SEGMENT = {
    "Champions": "Reward loyalty, protect experience, drive referrals and upsell.",
    "Loyal customers": "Maintain engagement with loyalty tiers and cross-sell.",
    "High-value at risk": "Personalised high-touch retention offer / win-back.",
    "New customers": "Second-purchase incentive and onboarding campaign.",
    "Occasional buyers": "Value-oriented offers and bundles to build habit.",
    "High-return customers": "Investigate product dissatisfaction; recommend alternatives; review CX.",
    "Lost customers": "Low-cost win-back; deprioritise unless value is high.",
}
STRATEGY_FALLBACK = "Monitor and re-evaluate at the next scoring cycle."
ACTION_BY_SEGMENT = {
    "Champions": "Reward loyalty; protect experience; drive referrals and upsell.",
    "Loyal customers": "Maintain engagement with loyalty tiers and cross-sell.",
    "High-value at risk": "Personalised high-touch retention offer and win-back.",
    "New customers": "Second-purchase incentive and onboarding campaign.",
    "Occasional buyers": "Value-oriented offers and bundles to build habit.",
    "High-return customers": "Investigate product dissatisfaction; review customer experience.",
    "Lost customers": "Low-cost win-back; deprioritise unless value is high.",
}
ACTION_BY_FACTOR = {
    "recency_days": "Win-back outreach with a personalised offer.",
    "n_orders": "Frequency incentive and second-purchase offer.",
    "n_orders_90": "Re-engagement campaign to rebuild purchase habit.",
    "n_orders_365": "Re-engagement campaign to rebuild purchase habit.",
    "revenue_90": "Targeted offer to reactivate declining spend.",
    "revenue_365": "Targeted offer to reactivate declining spend.",
    "recent_revenue_share": "Reactivation offer for lapsing spend.",
    "avg_interval": "Replenishment reminders and product bundles.",
    "return_value_ratio": "Investigate product dissatisfaction; recommend alternatives.",
    "is_single_purchase": "Onboarding and second-purchase incentive.",
    "tenure_days": "Onboarding and second-purchase incentive.",
    "purchase_frequency": "Loyalty tier and cross-sell programme.",
    "product_diversity": "Personalised recommendations to broaden the basket.",
}
ACTION_FALLBACK = "Include in the next retention test; monitor."
STRATEGY_SCORES = {
    "recency_rule": "recency_days",
    "churn_probability": "churn_probability",
    "expected_clv": "expected_future_clv",
    "revenue_at_risk": "revenue_at_risk",
}
VALUE_PROXY_DEFINITION = "12 x observed monthly net revenue (annualised run-rate)"
ISSUE_TEXTS = {
    "empty": "Cleaned transactions dataset is empty",
    "missing_column": "Missing required column: {}",
    "null_customer": "Null customer_id values present after cleaning",
    "null_date": "Null invoice_date values present after cleaning",
    "few_customers": "Fewer than two unique customers in the dataset",
    "early": "Earliest invoice %s precedes %s",
    "late": "Latest invoice %s is after %s",
    "empty_curated": "Curated transactions dataset is empty",
    "missing_curated": "Missing curated columns: {}",
    "bad_codes": " stock codes fail format {}: ",
    "negative_price": " rows have negative unit_price",
    "null_rows": " rows have nulls in critical columns",
    "zero_price": " zero-price lines flagged and excluded from monetary features",
}
CAPTURE_FRACTIONS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0)
RATIO_EPSILON = 1e-6
DAYS_PER_MONTH = 30.44


@dataclass(frozen=True)
class CleaningParams:
    drop_missing_customer: bool = True
    drop_non_product: bool = True
    non_product_codes: tuple[str, ...] = NON_PRODUCT_CODES
    # False keeps identical lines that came from different sources.
    dedup_ignores_source: bool = False


@dataclass(frozen=True)
class QualityExpectations:
    min_invoice_date: str | None = "2009-12-01"
    max_invoice_date: str | None = "2011-12-31"
    stock_code_pattern: str = STOCK_CODE_PATTERN


@dataclass(frozen=True)
class CurationParams:
    residual_admin_codes: tuple[str, ...] = RESIDUAL_ADMIN_CODES
    lower_quantile: float = 0.001
    upper_quantile: float = 0.999
    # Features use uncapped values, so a run that only feeds them may skip the caps.
    cap_tails: bool = True
    min_lines_per_country: int = 100
    other_label: str = "Other"


@dataclass(frozen=True)
class TemporalParams:
    cutoff_date: str = "2011-06-09"
    performance_window_days: int = 90
    # 90 must be present: the momentum features compare the last 90 days.
    recent_windows: tuple[int, ...] = (30, 90, 180, 365)
    # Column summed as revenue; "line_revenue_winsorised" is the robust choice.
    revenue_column: str = "line_revenue"
    # True leaves zero-price and cancelled lines out of the purchases.
    eligible_lines_only: bool = False


@dataclass(frozen=True)
class BaselineParams:
    inactivity_days: int = 90


@dataclass(frozen=True)
class ChurnParams:
    cohort_dates: tuple[str, ...] = (
        "2011-03-01",
        "2011-04-01",
        "2011-05-01",
        "2011-06-01",
        "2011-07-01",
        "2011-08-01",
        "2011-09-01",
    )
    train_cohorts: tuple[str, ...] = (
        "2011-03-01",
        "2011-04-01",
        "2011-05-01",
        "2011-06-01",
        "2011-07-01",
    )
    validation_cohorts: tuple[str, ...] = ("2011-08-01",)
    test_cohorts: tuple[str, ...] = ("2011-09-01",)
    target: str = "churn"
    id_columns: tuple[str, ...] = ("customer_id", "cohort_date")
    categorical_features: tuple[str, ...] = ("country_grouped",)
    exclude_features: tuple[str, ...] = ("future_revenue", "future_orders")
    models: tuple[str, ...] = ("logistic_regression", "random_forest", "gradient_boosting")
    logistic_max_iter: int = 2000
    logistic_c: float = 1.0
    forest_trees: int = 400
    forest_min_leaf: int = 5
    forest_max_depth: int = 12
    boosting_rounds: int = 400
    boosting_rate: float = 0.05
    boosting_depth: int = 5
    boosting_subsample: float = 0.8
    boosting_feature_share: float = 0.8
    boosting_min_rows: int = 20
    calibration_method: str = "isotonic"
    seed: int = 42


@dataclass(frozen=True)
class SurvivalParams:
    features: tuple[str, ...] = SURVIVAL_FEATURES
    penalizer: float = 0.1
    max_iterations: int = 50
    tolerance: float = 1e-9


@dataclass(frozen=True)
class ValueParams:
    target: str = "future_revenue"
    id_columns: tuple[str, ...] = ("customer_id", "cohort_date")
    categorical_features: tuple[str, ...] = ("country_grouped",)
    exclude_features: tuple[str, ...] = ("churn", "future_orders")
    # "gradient_boosting" (squared errors) and "tweedie_glm" can be added.
    models: tuple[str, ...] = ("ridge", "random_forest", "tweedie")
    ridge_alpha: float = 1.0
    forest_trees: int = 300
    forest_min_leaf: int = 5
    forest_max_depth: int = 12
    boosting_rounds: int = 400
    boosting_rate: float = 0.05
    boosting_depth: int = 5
    boosting_subsample: float = 0.8
    boosting_feature_share: float = 0.8
    boosting_min_rows: int = 20
    tweedie_variance_power: float = 1.5
    tweedie_penalty: float = 0.01
    selection_metric: str = "mae"
    horizon_days: float = 365.0
    discount_rate_annual: float = 0.0
    min_retention_probability: float = 0.1
    seed: int = 42


@dataclass(frozen=True)
class SegmentationParams:
    cluster_features: tuple[str, ...] = CLUSTER_FEATURES
    log_features: tuple[str, ...] = LOG_FEATURES
    k_range: tuple[int, ...] = (2, 3, 4, 5, 6, 7, 8)
    models: tuple[str, ...] = ("kmeans", "gmm", "hierarchical")
    kmeans_restarts: int = 10
    gmm_max_iter: int = 100
    gmm_tolerance: float = 1e-3
    # Customers whose silhouette is measured against all; exact if there are no more.
    silhouette_sample: int = 5000
    seed: int = 42
    high_return_threshold: float = 0.5
    new_customer_days: int = 180
    # Best recency score. 6 makes scores 2..6, which leaves the rule for lost
    # customers without members; 5 gives the conventional 1..5.
    recency_score_top: int = 6
    strategies: dict[str, str] = field(default_factory=lambda: dict(STRATEGY_BY_SEGMENT))


@dataclass(frozen=True)
class PriorityParams:
    budgets: tuple[int, ...] = (100, 250, 500, 1000)
    high_value_quantile: float = 0.75
    recency_threshold_days: int = 90


@dataclass(frozen=True)
class ExplainParams:
    top_factors: int = 5


@dataclass(frozen=True)
class ActionParams:
    by_segment: dict[str, str] = field(default_factory=lambda: dict(ACTION_BY_SEGMENT))
    by_factor: dict[str, str] = field(default_factory=lambda: dict(ACTION_BY_FACTOR))
    fallback: str = ACTION_FALLBACK
