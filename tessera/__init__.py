"""tessera: training-data preparation and measurement as Spark DataFrame jobs.

Every operator takes and returns a DataFrame.  Ordered operators carry an
explicit ``pos`` column (0-based, dense) because DataFrames are unordered.
"""

import sys as _sys

# Functions that run in Python workers (mapInPandas bodies, pandas UDFs) are
# pickled by value, so executors need neither this package installed nor the
# driver's working directory on their path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: executors import the package instead
    pass

from tessera.session import build_session, checkpoint_dir  # noqa: E402,F401

__all__ = ["build_session", "checkpoint_dir"]
