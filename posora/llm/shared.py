"""What the training-data operators share: scratch tables, word hashes, summed vectors."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Scratch:
    """Written tables that cut lineage, in the folder that ``spark.checkpoint.dir`` names.

    A table written here survives lost executors and is read back with its
    schema. The folder is named after the application and goes at its end; a
    step drops tables that no later result reads.
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

    def release(self) -> None:
        """Between large steps: let Spark delete the shuffle files of finished jobs, which it does when the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """word bytes -> 64-bit hash, with a bounded number of remembered bytes."""

    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.limit, self.held = limit, 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 256:
            if self.held >= self.limit:
                self.clear()
                self.held = 0
            self.held += len(word)
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def of_text(self, text: str | None, part: int = 1 << 22) -> np.ndarray:
        """The hashes of a text's lower-cased words; a long text is split into words part by part."""
        if not text:
            return np.empty(0, np.uint64)
        raw = text.encode("utf-8", "surrogatepass").lower()
        if len(raw) <= part:
            return self.of(raw.split())
        found, at = [], 0
        while at < len(raw):
            gap = _GAP.search(raw, at + part)
            end = gap.start() if gap else len(raw)
            found.append(self.of(raw[at:end].split()))
            at = end
        return np.concatenate(found)


_GAP = re.compile(rb"[\x20\x09-\x0d]")
_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * _M
    x = (x ^ (x >> np.uint64(32))) * _M
    return x ^ (x >> np.uint64(32))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n-word window, in order; of the whole sequence when it is shorter."""
    if not len(h):
        return h
    k = min(n, len(h))
    m = len(h) - k + 1
    acc = np.full(m, k, np.uint64)
    for i in range(k):
        acc = acc * _P + h[i : i + m]
    return mixed(acc)


def slices(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """The batches in slices, so that what is made of texts at a time stays small."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


def vectors(total: dict[str, np.ndarray]) -> pd.DataFrame:
    """Rows of key and vec."""
    return pd.DataFrame({"key": list(total), "vec": [v.tobytes() for v in total.values()]}, dtype=object)


def summed(parts: DataFrame, dtype: str = "int64", fan: int = 16) -> dict[str, np.ndarray]:
    """Sum ``vec`` (binary, equal lengths) by ``key`` in two streamed levels.

    Each task holds one running vector for each key, so its memory depends on
    the number of keys and not on the number of rows. The caller bounds keys
    and vector length; the driver gets one vector for each key.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for key, vec in zip(pdf["key"], pdf["vec"], strict=True):
                v = np.frombuffer(vec, dtype)
                total[key] = total[key] + v if key in total else v
        if total:
            yield vectors(total)

    first = parts.withColumn("_at", F.pmod(F.xxhash64("vec"), F.lit(fan))).repartition(fan, "_at").select("key", "vec").mapInPandas(add, "key string, vec binary")
    last = first.repartition(4, "key").mapInPandas(add, "key string, vec binary")
    return {r["key"]: np.frombuffer(r["vec"], dtype) for r in last.collect()}


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column ``doc``, so that names of an operator's own can't clash with theirs."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
