"""All registered questions."""

from ionloom.plans import catalog_models, catalog_pictures, catalog_regions, catalog_tables  # noqa: F401
from ionloom.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
