"""Session, storage and key helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = (1 << 63) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may lack the setting; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again.

    A written table outlives the executor that made it, and unlike a cached
    one it never has to be computed again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete a table made by ``save`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the caller's columns that start with ``_p_`` renamed, and their names.

    So internal columns never meet the caller's, whatever these are called.
    """
    taken = {c.lower() for c in df.columns}
    names: dict[str, str] = {}
    for c in df.columns:
        if c.lower().startswith("_p_"):
            k = 0
            while f"_o{k}_{c}".lower() in taken:
                k += 1
            names[f"_o{k}_{c}"] = c
            taken.add(f"_o{k}_{c}".lower())
    return df.withColumnsRenamed({c: new for new, c in names.items()}), names


def restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The caller's names again; a result of the operator replaces a column of its name."""
    have = {c.lower() for c in df.columns}
    lost = [new for new, c in names.items() if c.lower() in have]
    return df.drop(*lost).withColumnsRenamed({new: c for new, c in names.items() if new not in lost})


def text_of(df: DataFrame, text: str) -> Column:
    return F.coalesce(df[text].cast("string"), F.lit(""))


def id_of(df: DataFrame, key: str) -> Column:
    """Sortable id: null after all others."""
    return F.coalesce(df[key].cast("long"), F.lit(NULL_ID))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, as the contracts of the word operators ask."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
