"""python -m missive: a run by the settings of the environment (MISSIVE_MESSAGES, MISSIVE_OUTPUTS and so on); the exit code is 0 if all is well."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .operators.validate import InvalidDataset
from .plans.run import run, settings
from .sources.messages import SourceError
from .sources.sealed import SealError


def main() -> int:
    spark = SparkSession.builder.appName("missive").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(spark, settings())
    except (InvalidDataset, SourceError, SealError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
