from rowkeeper.checks import (  # noqa: F401
    aggregates, filters, fleet, joins, maintenance, ordering, reshape, scalars, sources, streaming, windows,
)
from rowkeeper.checks.registry import ORACLE, QUERIES  # noqa: F401
