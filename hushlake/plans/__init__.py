"""Named queries over the lake tables and the SQL that checks them."""

from hushlake.plans import detection, records, sanitizing, screens  # noqa: F401
from hushlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
