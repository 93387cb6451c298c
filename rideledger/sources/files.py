"""Streams and sinks over files, and folders that every executor sees."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rideledger.functions.keys import key
from rideledger.schemas import LATENCY_RECORD, RIDE_EVENT, SKIER_DAY


def workspace(spark: SparkSession) -> str:
    """A new folder below the shared one that the cluster names. Only a local master, whose executors share this machine, gets another."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="rideledger-")
    return f"{shared.rstrip('/')}/work-{uuid.uuid4().hex}"


_FIELDS = ["resortID", "seasonID", "dayID", "skierID", "liftID", "time"]


def envelopes(rides: DataFrame) -> DataFrame:
    """Rides as JSON records for a queue or file: ingest_seq, value."""
    return rides.select("ingest_seq", F.to_json(F.struct(*_FIELDS)).alias("value"))


def keyed_envelopes(rides: DataFrame) -> DataFrame:
    """Rides as records of a queue: key (a person's day at a resort, so that its rides stay in order) and value, which has ingest_seq."""
    return rides.select(key(*SKIER_DAY).alias("key"), F.to_json(F.struct("ingest_seq", *_FIELDS)).alias("value"))


def write_json(rides: DataFrame, folder: str, files: int) -> None:
    """Rides as JSON files, each a range of ingest_seq."""
    rides.repartitionByRange(files, "ingest_seq").write.json(folder)


def ride_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Rides from JSON files as they appear, a bounded number of files a step. A line that isn't JSON has null fields.

    Files may lie in folders, as publish() leaves them.
    """
    options = {"maxFilesPerTrigger": str(files_per_batch), "recursiveFileLookup": "true"}
    return spark.readStream.schema(RIDE_EVENT).options(**options).json(folder)


def record_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Records as they came (value), and the file they came in (origin), a bounded number of files a step."""
    options = {"maxFilesPerTrigger": str(files_per_batch), "recursiveFileLookup": "true"}
    return spark.readStream.options(**options).text(folder).select("value", F.col("_metadata.file_path").alias("origin"))


def record_stream_kafka(spark: SparkSession, servers: str, topic: str, per_batch: int = 1_000_000) -> DataFrame:
    """The same from a Kafka topic, origin being topic, partition and offset; needs the Kafka package on the classpath."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "maxOffsetsPerTrigger": str(per_batch)}
    raw = spark.readStream.format("kafka").options(**options).load()
    return raw.select(F.col("value").cast("string").alias("value"), F.concat_ws("/", "topic", "partition", "offset").alias("origin"))


def decoded(records: DataFrame) -> DataFrame:
    """records (value, ...) plus the fields of a ride and unreadable: true where value is no JSON object of such fields."""
    corrupt = "_corrupt_record"
    parsed = F.from_json("value", f"{RIDE_EVENT}, {corrupt} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    read = records.withColumn("__ride", parsed)
    unreadable = F.col("__ride").isNull() | F.col(f"__ride.{corrupt}").isNotNull()
    return read.select(*records.columns, *[F.col(f"__ride.{c}") for c in ("ingest_seq", *_FIELDS)], unreadable.alias("unreadable"))


def write_latency_csv(records: DataFrame, folder: str) -> None:
    """start_time, request_type, latency_ms, response_code, with that header in each file."""
    out = records.select(F.col("start_ms").alias("start_time"), "request_type", "latency_ms", "response_code")
    out.write.option("header", True).csv(folder)


def read_latency_csv(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LATENCY_RECORD).option("header", True).csv(folder)
