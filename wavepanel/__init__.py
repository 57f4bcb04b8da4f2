"""wavepanel: snapshot-panel analytics on Spark DataFrames."""

import sys as _sys

from .columns import CLEAN, FIXTURE, PanelCols
from .session import build_session, materialize

# The few Python functions that run on executors (pandas UDF, mapInPandas,
# applyInPandas bodies) are shipped by value with the task, so executors do
# not need this package installed or on their path.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: ship the package with --py-files instead
    pass

__all__ = ["CLEAN", "FIXTURE", "PanelCols", "build_session", "materialize"]
__version__ = "0.1.0"
