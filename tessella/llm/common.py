"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words everywhere in this package.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression of one or more of them.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, whose Python may not find it by itself; once a Spark context."""
    context = spark.sparkContext
    if not getattr(context, "_tessella_shipped", False):
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="spark-")) / "tessella-code.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, f"{root.name}/{path.relative_to(root)}")
        context.addPyFile(str(archive))
        context._tessella_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see. Where it is unset, a fresh one if all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Lists to which ``cut`` adds the tables it writes, while they are open.
_LISTS: list[list[DataFrame]] = []


@contextlib.contextmanager
def listed() -> Iterator[list[DataFrame]]:
    """A list of all tables that ``cut`` writes meanwhile, for whoever knows when nothing reads them any more."""
    tables: list[DataFrame] = []
    _LISTS.append(tables)
    try:
        yield tables
    finally:
        _LISTS.remove(tables)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: later steps do not run it again, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    for tables in _LISTS:
        tables.append(out)
    return out


def dropped(df: DataFrame) -> None:
    """Removes the files of a table that ``cut`` wrote and that nothing reads any more."""
    jvm, path = df.sparkSession._jvm, df._cut_at
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, even where body uses it inside another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
