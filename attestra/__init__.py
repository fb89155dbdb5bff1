"""attestra: content integrity, provenance and corpus preparation on Spark SQL."""

__version__ = "0.1.0"


def ship_by_value() -> None:
    """Pickle this package's functions by value, so that executors need no copy of it on their path."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


ship_by_value()
