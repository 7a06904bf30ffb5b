"""Bills of materials for AI models and datasets as Spark jobs."""

from ledgerloom.operators.graph import bundle_summary, link_bundle, recursive_walk
from ledgerloom.operators.resolve import resolve, resolve_dates, resolve_fields
from ledgerloom.operators.routing import parse_report, route, select_sources
from ledgerloom.plans.bom import build, direct_answers, inferred_fields

__all__ = ["build", "bundle_summary", "direct_answers", "inferred_fields", "link_bundle", "parse_report", "recursive_walk", "resolve", "resolve_dates", "resolve_fields", "route", "select_sources"]
