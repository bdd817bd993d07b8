"""Raster, tile and corpus analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors travel with the plan, so that no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
