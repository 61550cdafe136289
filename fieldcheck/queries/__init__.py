"""Every operator as a query over the test tables, with an equivalent SQL statement."""

from fieldcheck.queries.base import QUERIES, ORACLES
from fieldcheck.queries import columns, jobs, reports, tables  # noqa: F401  (they register)

__all__ = ["QUERIES", "ORACLES"]
