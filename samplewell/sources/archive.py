"""The sample archive: partitioned Parquet, range scans with partition pruning, the old directory layout, footer calibrations."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewell.functions import timefmt
from samplewell.operators import calibrate
from samplewell.sources import folders

#: Fixed value: the old layout, assetNNN/YYYY-MM-DD/chNN/part-NNNN.parquet.
OLD_PATH = r"asset(\d+)/(\d{4}-\d{2}-\d{2})/ch(\d+)/part-(\d+)\.parquet$"
#: Time in one file, so that no task has to write a whole day of a fast channel.
FILE_NS = 6 * 3600 * timefmt.NS
#: Footers that are read at once.
FOOTER_READERS = 32


def with_date(samples: DataFrame, time: str = "timestamp_unix_ns") -> DataFrame:
    return samples.withColumn("date", timefmt.utc_date(F.col(time)))


def write(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by asset, date and channel, in files of FILE_NS each; sorted by time in each file, so that row groups can be skipped by time."""
    d = with_date(samples)
    d.repartition("asset", "date", "channel", timefmt.floor_div(F.col("timestamp_unix_ns"), FILE_NS)).sortWithinPartitions("asset", "date", "channel", "timestamp_unix_ns").write.mode(mode).partitionBy("asset", "date", "channel").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The archive; corrupt and vanished files are skipped."""
    return spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(path)


def range_scan(archive: DataFrame, asset: int, channels: list[int], start_ns: int, end_ns: int) -> DataFrame:
    """Samples from start to end, both included; the dates that follow from the bounds are tested too, which prunes partitions."""
    bounds = [timefmt.utc_date(F.lit(n).cast("bigint")) for n in (start_ns, end_ns)]
    return archive.where((F.col("asset") == asset) & F.col("channel").isin(sorted(set(channels))) & F.col("date").between(*bounds) & F.col("timestamp_unix_ns").between(start_ns, end_ns))


def read_old_layout(spark: SparkSession, root: str, asset: int, channels: list[int], days: list[str]) -> DataFrame:
    """Files of the old layout for the given channels and days (missing directories are skipped); asset, date and channel come from the path."""
    jvm = spark.sparkContext._jvm
    # One pattern, so that the file system lists the directories of the days and channels that exist.
    pattern = jvm.org.apache.hadoop.fs.Path(f"{root}/asset{asset:03d}/{{{','.join(days)}}}/{{{','.join(f'ch{c:02d}' for c in sorted(set(channels)))}}}")
    listed = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) if days and channels else None
    found = [s.getPath().toString() for s in listed or []]
    schema = "timestamp_unix_ns bigint, value double"
    if not found:
        return spark.createDataFrame([], schema + ", asset bigint, date date, channel bigint, file string")
    d = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("pathGlobFilter", "part-*.parquet").parquet(*found)
    part = lambda k: F.regexp_extract(F.col("_metadata.file_path"), OLD_PATH, k)
    return d.select("timestamp_unix_ns", "value", part(1).cast("bigint").alias("asset"), part(2).cast("date").alias("date"), part(3).cast("bigint").alias("channel"), F.col("_metadata.file_path").alias("file"))


def footer_calibrations(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, spec JSON) from the `calibration` entry of each file's footer, through Hadoop's file system; absent or invalid means identity."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def spec(f: str) -> str:
        try:
            source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f), conf)
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
            try:
                text = reader.getFileMetaData().getKeyValueMetaData().get("calibration")
            finally:
                reader.close()
            json.loads(text)
            return text
        except Exception:  # unreadable footer, no entry, or no JSON: identity, as for files without calibration
            return '{"type":"identity"}'

    with ThreadPoolExecutor(FOOTER_READERS) as pool:  # a few kB a file: the request bounds the list
        return spark.createDataFrame(list(zip(files, pool.map(spec, files))), "file string, spec string")


def write_calibrated(samples: DataFrame, intervals: DataFrame, path: str, mode: str = "append") -> None:
    """The archive with column `calibration`: the JSON of the spec in effect at each sample's time (identity where there is none).

    intervals: as calibrate.as_of takes them. A change of calibration begins a new file: files have one spec each, whose hash is the last partition column, spec_key.
    """
    d = calibrate.as_of(samples, intervals)
    d = with_date(d.withColumn("calibration", F.coalesce(F.to_json("spec"), F.lit('{"type":"identity"}'))).drop("spec")).withColumn("spec_key", F.concat(F.lit("s"), F.hex(F.xxhash64("calibration"))))
    by = ["asset", "date", "channel", "spec_key"]
    d.repartition(*by).sortWithinPartitions(*by, "timestamp_unix_ns").write.mode(mode).partitionBy(*by).parquet(path)


def calibrated(rows: DataFrame) -> DataFrame:
    """Rows of such an archive with calibrated_value and calibration_id, by the spec beside each sample."""
    spec = F.from_json("calibration", calibrate.SPEC)
    d = rows.withColumn("_spec", spec)
    return d.withColumn("calibrated_value", calibrate.apply(F.col("value"), F.col("_spec"))).withColumn("calibration_id", F.coalesce("_spec.id", F.lit("identity"))).drop("_spec")


def next_part_index(files: DataFrame, directory: str, name: str) -> DataFrame:
    """Greatest index of part-N.parquet in each directory plus one, 0 if there is none; other names don't count."""
    n = F.regexp_extract(name, r"^part-(\d+)\.parquet$", 1).try_cast("bigint")
    return files.groupBy(directory).agg((F.coalesce(F.max(n), F.lit(-1)) + 1).alias("next_index"))


def roundtrip(samples: DataFrame) -> DataFrame:
    """Write to a new archive in the shared folder and read it back."""
    spark = samples.sparkSession
    path = f"{folders.shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    folders.delete_at_exit(spark, path)
    write(samples.select("asset", "channel", "timestamp_unix_ns", "value"), path)
    return read(spark, path)
