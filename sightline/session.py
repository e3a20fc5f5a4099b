"""What the package needs of a session."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


#: Bytes of a generated method. The virtual machine doesn't compile longer ones than 8000, and the long
#: chains of crop geometry then run several times slower than in the smaller methods without whole-stage code.
_METHOD_LIMIT, _DEFAULT_LIMIT = "spark.sql.codegen.hugeMethodLimit", "65535"


def ensure_importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver found it, and keeps generated code in what is compiled.

    On a cluster the package is installed, or sent with ``--py-files``; this only
    helps a session that was started from another folder of the same machine.
    """
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parent.parent)
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)
    if spark.conf.get(_METHOD_LIMIT, _DEFAULT_LIMIT) == _DEFAULT_LIMIT:
        spark.conf.set(_METHOD_LIMIT, "8000")
