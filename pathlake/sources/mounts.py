"""The mount table and root discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlake.functions.codecs import octal_unescape_udf
from pathlake.schema import NETWORK_FSTYPES


def read_mounts(spark: SparkSession, path: str = "/proc/self/mounts") -> DataFrame:
    """(device, point, fstype) of a mount table."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") >= 3)
    return rows.select(octal_unescape_udf(F.col("p")[0]).alias("device"), octal_unescape_udf(F.col("p")[1]).alias("point"), F.col("p")[2].alias("fstype"))


def removable_mounts(mounts: DataFrame, removable: list[str]) -> DataFrame:
    """User-mounted removable media: /dev devices, not of the network, on a removable disk, under /media or /run/media."""
    disk = F.regexp_extract("device", r"^/dev/([a-z]+|nvme\d+n\d+|mmcblk\d+)", 1)
    user = F.col("point").rlike("^(/media|/run/media|/mnt)/")
    return mounts.filter(F.col("device").startswith("/dev/") & ~F.col("fstype").isin(NETWORK_FSTYPES) & disk.isin(removable) & user)
