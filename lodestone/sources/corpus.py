"""Documents to index: id, url, title, description, words, forward_links. Made from text tables, web pages or a folder of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions.text import words

DOCUMENT = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("url", StringType()),
        StructField("title", ArrayType(StringType())),
        StructField("description", ArrayType(StringType())),
        StructField("words", ArrayType(StringType())),
        StructField("forward_links", ArrayType(StringType())),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table: the title is the first 15 words of the first line, the description the second line."""
    return from_texts(spread(table(spark, sf_dir, "documents")))


def spread(d: DataFrame) -> DataFrame:
    """A table of fewer splits than there are cores over all of them; any other as it is."""
    n = d.sparkSession.sparkContext.defaultParallelism
    return d.repartition(n) if d.rdd.getNumPartitions() < n else d


def from_texts(d: DataFrame) -> DataFrame:
    """doc_id, text, lang, source as documents to index."""
    text = F.coalesce("text", F.lit(""))
    return d.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.slice(words(F.split_part(text, F.lit("\n"), F.lit(1))), 1, 15).alias("title"),
        words(F.split_part(text, F.lit("\n"), F.lit(2))).alias("description"),
        words(text).alias("words"),
        F.array().cast("array<string>").alias("forward_links"),
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A folder of stored documents; files that can't be read are skipped, rows without an id or url dropped."""
    return spark.read.schema(DOCUMENT).option("ignoreCorruptFiles", "true").parquet(path).filter("doc_id is not null and url is not null")


def write_documents(docs: DataFrame, path: str, codec: str = "gzip", per_file: int = 10_000) -> None:
    """Documents in files of at most per_file."""
    docs.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DOCUMENT]).write.option("compression", codec).option("maxRecordsPerFile", per_file).parquet(path)


def numbered(docs: DataFrame, start: int = 0) -> DataFrame:
    """Ids from start on in order of url. Each range of urls counts on its own; the ranges' sizes, summed, give where each starts."""
    from pyspark.sql import Window

    ranged = docs.drop("doc_id").repartitionByRange("url").sortWithinPartitions("url").withColumn("_p", F.spark_partition_id())
    ranged = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy("url")))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_k"))
    # one row for each partition
    base = sizes.withColumn("_b", F.coalesce(F.sum("_k").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_k")
    return ranged.join(F.broadcast(base), "_p").withColumn("doc_id", F.lit(start) + F.col("_b") + F.col("_n") - 1).drop("_p", "_n", "_b")
