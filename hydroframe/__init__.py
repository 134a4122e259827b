"""Hydrologic station data on Spark: readers, station tables, refreshable store."""

import os
import sys
from pathlib import Path

from pyspark import cloudpickle

_ROOT = Path(__file__).resolve().parent.parent


def _found_by_workers() -> bool:
    """Whether Python workers started from here can import this package themselves."""
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    return "site-packages" in _ROOT.parts or any(Path(p).resolve() == _ROOT for p in places if p)


# Functions that run in Python workers are found there by name, or travel with their tasks.
if not _found_by_workers():
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
