"""lectern: parallel-text and speech corpus preparation and scoring on Spark.

Every public function takes and returns Spark DataFrames (or Columns); the
work is planned by Catalyst and runs on the executors.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value so Python workers need no
    installed copy (pandas UDFs and ``mapInPandas`` bodies live here)."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - Spark is a hard dependency
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
