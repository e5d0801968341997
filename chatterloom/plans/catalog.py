"""All named queries; importing a group registers its queries."""

from chatterloom.plans import cor, grf, io, lm, rel, sen, tok, top, txt  # noqa: F401
from chatterloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
