"""All registered queries of the library."""

from quillmesh.plans import boards, catalog, code, knowledge, records, search, stores  # noqa: F401  they register themselves
from quillmesh.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
