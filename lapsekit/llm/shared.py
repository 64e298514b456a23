"""Written intermediate tables in the shared folder, and helpers all operators use."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every machine sees: ``spark.checkpoint.dir``; where it is unset, one in the session's warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/lapsekit-work"
    return folder.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session: tasks import it wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_lapsekit_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="lapsekit-")) / "lapsekit_sources.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in [*root.glob("lapsekit/**/*.py"), root / "corpus_pipeline.py"]:
            out.write(file, file.relative_to(root))
    context.addPyFile(str(archive))
    context._lapsekit_shipped = True


class Work:
    """Written tables of one operator run.

    ``keep`` writes a table and reads it back, which cuts the lineage: an executor that is lost later costs a read,
    not the work behind it. ``drop`` deletes tables no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, free: bool = True, **options: str) -> DataFrame:
        """``free`` also lets go of the shuffles behind ``df``; not worth the time for a small one."""
        df.write.options(**options).parquet(f"{self.path}/{name}")
        out = self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")
        del df
        if free:
            self.free()
        return out

    def free(self) -> None:
        """Let go of finished shuffles: their files stay until the driver forgets them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def documents(df: DataFrame) -> DataFrame:
    """The two columns operators read; a null text is empty."""
    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n
