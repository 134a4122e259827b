"""Session settings for a part of a test."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def settings(spark: SparkSession, **values: str | int) -> Iterator[None]:
    """Session settings (`__` for `.`) that hold for the jobs started inside."""
    names = {key: key.replace("__", ".") for key in values}
    before = {key: spark.conf.get(name, None) for key, name in names.items()}
    try:
        for key, value in values.items():
            spark.conf.set(names[key], str(value))
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(names[key])
            else:
                spark.conf.set(names[key], value)
