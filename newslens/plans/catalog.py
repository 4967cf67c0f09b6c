"""Loads every query module, which fills the registry."""

from newslens.plans import (  # noqa: F401
    evaluation_queries,
    event_queries,
    feed_queries,
    headline_queries,
    report_queries,
    scoring_queries,
    story_queries,
    stream_queries,
)
from newslens.plans.registry import ORACLE, QUERIES  # noqa: F401
