"""All registered array queries; importing the modules registers them."""

from . import archive_queries, array_queries, checked_queries, decomposition_queries, kernel_queries, table_queries  # noqa: F401
from .tables import ORACLES, QUERIES  # noqa: F401
