"""Queries by name: importing this package registers all of them."""

from metaloom.plans import assembly, catalog, code, ddl, flows, governance, graph, incremental, models, procedures, relations  # noqa: F401
from metaloom.plans import aggregates  # noqa: F401, I001  after those whose SQL it builds on
from metaloom.plans.registry import ORACLES, QUERIES  # noqa: F401
