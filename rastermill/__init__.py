"""Raster-grid analytics expressed as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel with the job, so executors need numpy,
# pandas and pyarrow but not the package itself.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
