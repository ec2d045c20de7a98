"""End-to-end plans and the registered queries, those that fit models last."""

# isort: off
from tideline.plans import customers, eda, lines, scores, targeting  # noqa: F401
from tideline.plans.registry import ORACLES as ALL_ORACLES  # noqa: F401
from tideline.plans.registry import QUERIES as ALL_QUERIES

PLAIN = tuple(ALL_QUERIES)

from tideline.plans import models, properties  # noqa: E402, F401

#: Names of the queries that fit models: they take long, so others should not wait for them.
FITTED = tuple(
    name
    for name in ALL_QUERIES
    if name not in (*PLAIN, "feature_selection", "feature_counts", "one_hot", "cox_ph_settles")
)
