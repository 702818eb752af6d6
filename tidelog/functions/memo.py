"""Large expressions are built once per application.

Building an expression of thousands of nodes costs seconds, all of them calls into the JVM;
running it costs less. A Column does not change and can be used in any number of queries.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext


def once_per_application(build: Callable) -> Callable:
    """For builders whose arguments are plain values; the Columns they use go by name."""
    built: dict = {}

    @wraps(build)
    def get(*args):
        key = (SparkContext._active_spark_context.applicationId, args)
        if key not in built:
            built[key] = build(*args)
        return built[key]

    return get
