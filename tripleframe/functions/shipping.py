"""Python functions that run inside tasks."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(module: str) -> None:
    """Send the functions of a module with their code, so that executors need not have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
