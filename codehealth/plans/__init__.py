"""Every query of the engine over the test tables: thin adapters around the public operators."""

from codehealth.plans import registry
from codehealth.plans import graph, history, portfolio, reports, source_code, streams  # noqa: F401  each registers its queries

QUERIES, SQL = registry.QUERIES, registry.SQL
