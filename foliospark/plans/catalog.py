"""All registered queries; importing this module fills the registry."""

from foliospark.plans import content, layouts, operations, paging, screening, streams, texts  # noqa: F401
from foliospark.plans.registry import ORACLES, QUERIES  # noqa: F401
