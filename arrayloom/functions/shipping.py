"""Functions for tasks on machines that have no copy of this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module: str) -> None:
    """Send a module's functions to workers by value."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
