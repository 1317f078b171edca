"""Tables that are audited before they are published, and a reader that trusts no table without its manifest.

A version is written aside, read back and held against what was to be written;
then it is renamed to its place and the pointer file is replaced. A reader that
holds the old pointer keeps reading the old version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ManifestError(ValueError):
    """A published table isn't what its manifest says."""


def content_of(df: DataFrame) -> dict:
    """Columns, rows and a fingerprint that doesn't depend on the order of rows; one pass, nothing collected but the sums."""
    fields = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"})
    digest = F.sha2(fields, 256)
    part = [F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)") for i in range(2)]
    sums = df.agg(F.count("*").alias("n"), *(F.sum(p).alias(f"s{i}") for i, p in enumerate(part))).first()
    return {"columns": [[f.name, f.dataType.simpleString()] for f in df.schema], "rows": sums["n"], "fingerprint": "-".join(str(int(sums[f"s{i}"] or 0)) for i in range(2))}


class Published:
    """Versions of a table in a folder of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self._kind = jvm.org.apache.hadoop.fs.Options.Rename

    def _write(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _text(self, path: str) -> str | None:
        if not self._fs.exists(self._path(path)):
            return None
        # through Spark, so that the folder may lie in any store that it reads
        return "\n".join(r["value"] for r in self.spark.read.text(path, wholetext=True).collect())

    def _replace(self, path: str, text: str) -> None:
        """A file appears whole or not at all."""
        aside = f"{path}.{uuid.uuid4().hex}"
        self._write(aside, text)
        kinds = self.spark.sparkContext._gateway.new_array(self._kind, 1)
        kinds[0] = self._overwrite
        self._context.rename(self._path(aside), self._path(path), kinds)

    def publish(self, df: DataFrame, check=None) -> int:
        """Write ``df`` as the next version and make it the current one; its number.

        ``check`` may look at the written table and raise. A version whose content differs from what ``df`` gave, or that ``check``
        refuses, is deleted and the current one stays.
        """
        wanted = content_of(df)
        current = self.current()
        version = (current or 0) + 1
        aside, place = f"{self.folder}/.aside-{uuid.uuid4().hex}", f"{self.folder}/v{version:06d}"
        df.write.parquet(f"{aside}/data")
        try:
            written = self.spark.read.parquet(f"{aside}/data")
            if content_of(written) != wanted:
                raise ManifestError("what was written differs from what was to be written")
            if check:
                check(written)
            self._write(f"{aside}/manifest.json", json.dumps(wanted, sort_keys=True))
        except Exception:
            self._fs.delete(self._path(aside), True)
            raise
        if not self._fs.rename(self._path(aside), self._path(place)):
            self._fs.delete(self._path(aside), True)
            raise ManifestError(f"version {version} is there already")
        self._replace(f"{self.folder}/current", str(version))
        return version

    def current(self) -> int | None:
        text = self._text(f"{self.folder}/current")
        return int(text) if text else None

    def read(self, version: int | None = None) -> DataFrame:
        """The current version, or the given one, after its content was held against its manifest."""
        version = version or self.current()
        if version is None:
            raise ManifestError("nothing is published here")
        place = f"{self.folder}/v{version:06d}"
        manifest = self._text(f"{place}/manifest.json")
        if manifest is None:
            raise ManifestError(f"version {version} has no manifest")
        df = self.spark.read.parquet(f"{place}/data")
        if content_of(df) != json.loads(manifest):
            raise ManifestError(f"version {version} isn't what its manifest says")
        return df
