"""The registered queries over the test tables."""

from . import decisions, diagnostics, retrieval, scoring, staged, stats, text

ALL = (text.PLANS, retrieval.PLANS, scoring.PLANS, decisions.PLANS, stats.PLANS, diagnostics.PLANS, staged.PLANS)
