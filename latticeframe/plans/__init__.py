"""The query language: text to tree, tree to logical plan, access-path choice, execution."""

from .language import MatchQuery, NearestQuery, parse
from .planner import CatalogStats, LogicalPlan, PhysicalPlan, explain, optimize, plan_logical, run

__all__ = ["CatalogStats", "LogicalPlan", "MatchQuery", "NearestQuery", "PhysicalPlan", "explain", "optimize", "parse", "plan_logical", "run"]
