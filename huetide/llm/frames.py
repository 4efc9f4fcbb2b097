"""Small things that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, keep: list[str] | tuple[str, ...], made: str | T.StructType) -> tuple[list[str], T.StructType]:
    """Input columns to carry along and the schema with what is made; a made column replaces an input column of its name."""
    made = T._parse_datatype_string(made) if isinstance(made, str) else made
    names = {f.name.lower() for f in made}
    carry = [c for c in keep if c.lower() not in names]
    return carry, T.StructType([df.schema[c] for c in carry] + list(made))


def with_text(docs: DataFrame, carry: list[str]) -> tuple[DataFrame, str]:
    """The columns to send to Python, and the name of the text among them: a text that is carried along isn't sent twice."""
    if "text" in carry and isinstance(docs.schema["text"].dataType, T.StringType):
        return docs.select(*carry), "text"
    return docs.select(*carry, F.col("text").cast("string").alias("_text")), "_text"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (a local session)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: its lineage ends there, so a lost executor costs no recomputation of what came before."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
