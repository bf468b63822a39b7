from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from weftline.operators.dataset import Dataset


def stream_parquet(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8) -> Dataset:
    """A growing folder of parquet files as an unbounded dataset."""
    return Dataset(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))
