"""All registered queries. Importing this package registers them."""

from tidemark.catalog import assessing, bundling, chaining, lifecycle, live, mapping, scalars, storing, verifying  # noqa: F401
from tidemark.catalog.base import REGISTRY, Query, Tables

__all__ = ["REGISTRY", "Query", "Tables"]
