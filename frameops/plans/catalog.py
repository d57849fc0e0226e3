"""Imports every module that registers queries."""

from frameops.plans import (  # noqa: F401
    box_queries,
    expression_queries,
    feature_queries,
    io_queries,
    model_queries,
    policy_queries,
    sample_queries,
    table_queries,
)
