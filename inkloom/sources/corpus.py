"""Scans of text corpora and JSON records, append-only snapshots, manifest merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

# Record schemas; nothing is inferred.
BLOCKS = T.ArrayType(
    T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType())])
)
FEATURE_SCHEMA_VERSION = "2"


def _abort(message: Column) -> Column:
    return F.raise_error(message).cast("boolean")


def read_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """article_id, path, text of .txt and .md files under the paths, a file once; a missing path is an error.

    Ids come from file stems; whole files are single rows, split over tasks by file.
    """
    files = spark.read.text(sorted(set(paths)), wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{txt,md}")
    # File names come percent-encoded.
    name = F.regexp_replace(F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))), "\\.(txt|md)$", "")
    return files.select(X.article_id_of(name).alias("article_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).dropDuplicates(["path"])


def new_snapshots(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of incoming(article_id, text) not yet stored. A stored id with another text aborts the query."""
    known = stored.select("article_id", X.content_hash(F.col("text")).alias("known")).distinct()
    checked = incoming.join(known, "article_id", "left")
    same = F.col("known").isNull() | (F.col("known") == X.content_hash(F.col("text")))
    # One expression, so that no row is left out before it is checked.
    wanted = F.when(F.col("known").isNull(), True).when(same, False).otherwise(_abort(F.concat(F.lit("snapshot differs: "), "article_id")))
    return checked.where(wanted).drop("known")


def merge_manifest(old: DataFrame, new: DataFrame, key: str = "article_id", first: str = "retrieval_timestamp", owner: str = "author_id") -> DataFrame:
    """Full outer merge by id: the new row's values where there is one, the older first timestamp; another author aborts."""
    o = old.select(*(F.col(c).alias(f"_{c}") for c in old.columns))
    j = new.join(o, new[key] == o[f"_{key}"], "full_outer")
    same = F.col(owner).isNull() | F.col(f"_{owner}").isNull() | (F.col(owner) == F.col(f"_{owner}"))
    cols = [F.coalesce(F.least(c, f"_{c}"), c, f"_{c}").alias(c) if c == first else F.when(F.col(key).isNotNull(), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in new.columns]
    return j.where(F.when(same, True).otherwise(_abort(F.lit("author differs")))).select(*cols)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON documents of a fixed schema, one object or array a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_records(df: DataFrame, path: str) -> None:
    """Parquet, replaced as a whole; Spark's commit makes the new files visible at once."""
    df.write.mode("overwrite").parquet(path)


def of_version(records: DataFrame, version: str = FEATURE_SCHEMA_VERSION) -> DataFrame:
    """Records, whose schema version must match; another one aborts, null ones too."""
    return records.where(F.when(F.col("feature_schema") == version, True).otherwise(_abort(F.lit("schema version differs"))))
