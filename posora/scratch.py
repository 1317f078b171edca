"""Written tables that cut lineage."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Written tables that cut lineage, in the folder that ``spark.checkpoint.dir`` names.

    A table written here survives lost executors and is read back with its
    schema. The folder is named after the application and goes at its end; a
    step drops tables that no later result reads. Without the setting only a
    local session works, in a temporary folder, with a warning.
    """

    _roots: dict[str, str] = {}

    def __init__(self, spark: SparkSession):
        self.spark = spark
        app = spark.sparkContext.applicationId
        if app not in self._roots:
            base = spark.conf.get("spark.checkpoint.dir", None)
            if not base:
                if not spark.sparkContext.master.startswith("local"):
                    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
                base = "file://" + tempfile.mkdtemp(prefix="posora-")
                logging.getLogger(__name__).warning("spark.checkpoint.dir is not set: tables between steps go to %s", base)
            self._roots[app] = f"{base.rstrip('/')}/posora-{app}"
            atexit.register(self._at_exit, self._roots[app])
        self.root = self._roots[app]

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _at_exit(self, path: str) -> None:
        try:
            self._delete(path)
        except Exception:  # the session may already be gone; the folder goes with the application's others
            pass

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return a reader of it."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)
