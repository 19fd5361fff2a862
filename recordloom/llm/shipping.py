"""Objects sent to tasks together with their classes."""

from __future__ import annotations

import pickle
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import SparkSession


def sent(spark: SparkSession, value: Any) -> Broadcast:
    """Broadcast of ``value`` as bytes that hold its classes too: executors have no copy of
    this package, and a broadcast by itself names a class by its module. See ``received``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(broadcast: Broadcast) -> Any:
    return pickle.loads(broadcast.value)
