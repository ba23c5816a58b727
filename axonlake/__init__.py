"""Event and point-process analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from axonlake.session import build_session, read_table, scratch_dir, table_names

# kernels travel to the executors by value, so that only the driver needs this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "read_table", "scratch_dir", "table_names"]
__version__ = "0.1.0"
