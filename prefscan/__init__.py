"""prefscan: prompt/response data selection and audit on Spark DataFrames."""

import sys as _sys

try:  # ship this package's functions inside Python UDF closures
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pickler: rely on --py-files
    pass

__version__ = "0.1.0"
