"""Reading texts and traffic, writing what may be written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.redact import public


class NotAnExport(ValueError):
    pass


_MESSAGE = "struct<_VALUE:string,_base64:string>"
ITEM = f"host struct<_VALUE:string,_ip:string>, port string, protocol string, method string, path string, extension string, status string, mimetype string, request {_MESSAGE}, response {_MESSAGE}"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def of_text(spark: SparkSession, text: str) -> DataFrame:
    """One text that is at hand, such as standard input."""
    return spark.createDataFrame([(text,)], "text string")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of an XML export, messages decoded; one with bad base64 is empty. The reader splits files by item."""
    raw = spark.read.schema(ITEM).option("rowTag", "item").xml(path)
    if not spark.read.text(path).where(F.col("value").rlike("<items[ >/]")).limit(1).count():
        raise NotAnExport(f"{path}: no <items> element")

    def message(c: str):
        body = F.regexp_replace(F.col(f"{c}._VALUE"), r"\s", "")
        decoded = F.when(F.char_length(body) % 4 == 0, F.try_to_binary(body, F.lit("base64")))
        return F.coalesce(F.when(F.col(f"{c}._base64") == "true", decoded).otherwise(F.encode(F.col(f"{c}._VALUE"), "UTF-8")), F.lit(b"")).alias(c)

    return raw.select(F.col("host._VALUE").alias("host"), "port", "protocol", "method", "path", "extension", "status", "mimetype", message("request"), message("response"))


def write_json(redacted: DataFrame, path: str, text: str = "text") -> None:
    """Outputs and findings; originals are left out."""
    public(redacted, text).write.json(path)


def write_text(redacted: DataFrame, path: str, output: str = "output") -> None:
    redacted.select(output).write.text(path)
