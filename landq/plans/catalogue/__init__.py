"""All named queries."""

from landq.plans.catalogue.registry import CATALOGUE
from landq.plans.catalogue import legal, regional, scoring, cadastral, imaging, workflow, archive_views, streams  # noqa: F401, I001

__all__ = ["CATALOGUE"]
