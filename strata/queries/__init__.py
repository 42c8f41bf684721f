"""Every operator as a query over the test tables, most with the SQL that gives the same rows."""

from strata.queries import checks, cleaning, landing, reuse, texts  # noqa: F401
from strata.queries.registry import ORACLES, QUERIES  # noqa: F401
