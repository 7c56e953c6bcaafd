"""Fingerprinted materialisation of prepared datasets.

The index is a log of small rows; the latest row of a key counts. A removed key gets a
row without a path. Every build has a folder of its own, so a replacement never writes where
a reader reads; what is replaced goes only when it is neither among the last few of its key
nor leased by a reader.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from hashlib import md5

from py4j.java_gateway import is_instance_of
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.files import age_seconds, create_new, delete_path, list_names, path_exists, scan_name

CHUNK = 1000
INDEX_SCHEMA = (
    "seq bigint, key string, fingerprint string, path string, files array<string>, "
    "config string, num_samples bigint"
)

# Signs of a stored dataset that is damaged or gone, which is built anew.
UNREADABLE = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE", "ChecksumException"}


def config_text(config: Mapping) -> str:
    """JSON with sorted keys."""
    return json.dumps(dict(config), sort_keys=True)


def file_entries(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """``(file_ord, entry)``: ``path:mtime:size``, or ``path:missing``, per listed file."""
    listed = spark.createDataFrame(
        [(i, p, scan_name(spark, p)) for i, p in enumerate(files)],
        "file_ord int, path string, __name string",
    )
    found = [p for p in dict.fromkeys(files) if path_exists(spark, p)]
    if not found:
        return listed.select("file_ord", F.concat("path", F.lit(":missing")).alias("entry"))
    meta = spark.read.format("binaryFile").load(found).select(
        F.regexp_replace("path", r"^file:/+", "/").alias("__name"), "modificationTime", "length"
    )
    stamp = F.concat_ws(
        ":", "path", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string")
    )
    missing = F.concat("path", F.lit(":missing"))
    return listed.join(meta, "__name", "left").select(
        "file_ord", F.when(F.col("length").isNotNull(), stamp).otherwise(missing).alias("entry")
    )


def fingerprint_of(entries: DataFrame, config: Mapping) -> DataFrame:
    """One row: the number of ``entries(file_ord, entry)`` and the SHA-256 over them and ``config``.

    Entries are hashed in order in chunks of ``CHUNK``, chunk hashes in chunks again, and the
    rest with the configuration, so no task holds the list.
    """
    level = entries.select(F.col("file_ord").alias("place"), F.col("entry").alias("part"), F.lit(1).alias("n"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "part"))), lambda s: s["part"]), "\n")
    for _ in range(2):
        level = level.groupBy(F.floor(F.col("place") / CHUNK).alias("chunk")).agg(
            F.sha2(joined, 256).alias("part"), F.sum("n").alias("n")
        ).withColumnRenamed("chunk", "place")
    return level.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"),
        F.sha2(F.concat(joined, F.lit("\n" + config_text(config))), 256).alias("fingerprint"),
    )


def fingerprint(spark: SparkSession, files: Sequence[str], config: Mapping) -> str:
    """SHA-256 over the listed files, in list order, and the configuration."""
    return fingerprint_of(file_entries(spark, files), config).head()["fingerprint"]


def _signs(spark: SparkSession, error: PySparkException | Py4JJavaError) -> set[str]:
    """Spark's error conditions, without their details, and the Java classes of an error and its causes."""
    if isinstance(error, PySparkException):
        return {(error.getCondition() or "").split(".")[0]}
    found, cause = set(), error.java_exception
    while cause is not None:
        found.add(cause.getClass().getSimpleName())
        if is_instance_of(spark.sparkContext._gateway, cause, "org.apache.spark.SparkThrowable"):
            found.add((cause.getCondition() or "").split(".")[0])
        cause = cause.getCause()
    return found


class DatasetCache:
    """Prepared datasets below ``root``, one live one per key.

    ``keep`` is how many datasets of a key stay, the live one included, so a frame that
    ``materialize`` gave outlives ``keep - 1`` replacements; ``reading`` holds one for longer.
    A claim older than ``claim_seconds`` is taken to be left by a lost session, as is a lease
    older than ``lease_seconds``; a build or reading that takes longer needs larger numbers.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        keep: int = 2,
        claim_seconds: float = 6 * 3600,
        lease_seconds: float = 24 * 3600,
        poll_seconds: float = 1.0,
    ):
        if keep < 1:
            raise ValueError("keep must be at least 1")
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self.claim_seconds, self.lease_seconds, self.poll_seconds = claim_seconds, lease_seconds, poll_seconds

    @property
    def _index_path(self) -> str:
        return f"{self.root}/_index"

    def _log(self) -> DataFrame:
        if not path_exists(self.spark, self._index_path):
            return self.spark.createDataFrame([], INDEX_SCHEMA)
        reader = self.spark.read.schema(INDEX_SCHEMA).option("recursiveFileLookup", True)
        return reader.parquet(self._index_path)

    def index(self) -> DataFrame:
        """The live entries."""
        row = F.struct("fingerprint", "path", "files", "config", "num_samples")
        return (
            self._log()
            .groupBy("key")
            .agg(F.max_by(row, "seq").alias("e"))
            .where("e.path is not null")
            .select("key", "e.*")
        )

    def _append(self, key, fp, path, files, config, n) -> None:
        """Log a row in a folder of its own, as sessions may log rows of other keys at the same time."""
        last = self._log().agg(F.max("seq")).head()[0]
        seq = 0 if last is None else last + 1
        self.spark.createDataFrame([(seq, key, fp, path, files, config, n)], INDEX_SCHEMA).coalesce(
            1
        ).write.parquet(f"{self._index_path}/{uuid.uuid4().hex}")

    def lookup(self, key: str, files: Sequence[str], config: Mapping) -> DataFrame | None:
        """The stored dataset if its fingerprint still holds and it can be read."""
        return self._stored(key, fingerprint(self.spark, files, config))

    def _stored(self, key: str, fp: str) -> DataFrame | None:
        entry = self._entry(key)
        if entry is None or entry["fingerprint"] != fp:
            return None
        try:
            df = self.spark.read.parquet(entry["path"])
            return df if df.count() == entry["num_samples"] else None
        except (PySparkException, Py4JJavaError) as e:
            if not UNREADABLE & _signs(self.spark, e):
                raise
            return None

    def _entry(self, key: str):
        return self.index().where(F.col("key") == key).head()

    def materialize(
        self,
        key: str,
        files: Sequence[str],
        config: Mapping,
        build: Callable[[], DataFrame],
    ) -> DataFrame:
        """Reuse the stored dataset, or build and store it.

        Of several sessions that ask for a key one builds; the others wait and take its result.
        """
        fp = fingerprint(self.spark, files, config)
        hit = self._stored(key, fp)
        if hit is not None:
            return hit
        with self._claimed(key):
            hit = self._stored(key, fp)  # another session may have built it while this one waited
            return hit if hit is not None else self._build(key, fp, files, config, build)

    @contextmanager
    def _claimed(self, key: str) -> Iterator[None]:
        """Alone in changing a key; waits for the session that is."""
        claim = self._claim(key)
        while claim is None:
            time.sleep(self.poll_seconds)
            claim = self._claim(key)
        try:
            yield
        finally:
            delete_path(self.spark, claim)

    def _claim(self, key: str) -> str | None:
        """The claim on a key, or none while another session holds it."""
        path = f"{self.root}/_claims/{md5(key.encode()).hexdigest()}"
        if create_new(self.spark, path, key):
            return path
        age = age_seconds(self.spark, path)
        if age is not None and age > self.claim_seconds:
            delete_path(self.spark, path)
        return None

    def _build(self, key: str, fp: str, files: Sequence[str], config: Mapping, build: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.root}/{key}-{fp[:8]}-{uuid.uuid4().hex[:8]}"
        try:
            build().write.mode("errorifexists").parquet(path)
            df = self.spark.read.parquet(path)
            n = df.count()
        except Exception:
            delete_path(self.spark, path)
            raise
        self._append(key, fp, path, list(files), config_text(config), n)
        self.prune(key)
        return df

    @contextmanager
    def reading(self, key: str) -> Iterator[DataFrame]:
        """The live dataset of a key, which stays readable inside the block whatever replaces it.

        The lease is written before the index is asked again, and ``prune`` asks the index
        before the leases, so one of the two sees the other.
        """
        while True:
            entry = self._entry(key)
            if entry is None:
                raise KeyError(f"nothing is stored under {key!r}")
            lease = f"{self.root}/_leases/{self._name(entry['path'])}/{uuid.uuid4().hex}"
            create_new(self.spark, lease, key)
            if entry["path"] in self._retained(key):
                break
            delete_path(self.spark, lease)
        try:
            yield self.spark.read.parquet(entry["path"])
        finally:
            delete_path(self.spark, lease)

    def _name(self, path: str) -> str:
        return path[len(self.root) + 1 :]

    def _leased(self, path: str) -> bool:
        folder = f"{self.root}/_leases/{self._name(path)}"
        ages = (age_seconds(self.spark, f"{folder}/{lease}") for lease in list_names(self.spark, folder))
        return any(age is not None and age <= self.lease_seconds for age in ages)

    def _history(self, key: str) -> list:
        """The log rows of a key, the latest first; one for each build and removal."""
        return self._log().where(F.col("key") == key).orderBy(F.desc("seq")).select("path").collect()

    def _retained(self, key: str) -> list[str]:
        rows = self._history(key)
        if not rows or rows[0]["path"] is None:
            return []
        return [r["path"] for r in rows if r["path"] is not None][: self.keep]

    def prune(self, key: str) -> int:
        """Delete the datasets of a key that are no longer kept nor leased; how many went."""
        built = [r["path"] for r in self._history(key) if r["path"] is not None]
        kept = self._retained(key)
        there = set(list_names(self.spark, self.root))
        due = [p for p in built if p not in kept and self._name(p) in there and not self._leased(p)]
        return sum(delete_path(self.spark, p) for p in due)

    def remove(self, key: str) -> bool:
        """Forget a key and delete its datasets; those under a lease go at a later ``prune``."""
        with self._claimed(key):
            if self._entry(key) is None:
                return False
            self._append(key, None, None, None, None, None)
            self.prune(key)
            return True

    def clear(self) -> None:
        for row in self.index().select("key").collect():  # one row per prepared dataset
            self.remove(row[0])

    def info(self) -> DataFrame:
        return cache_info(self.index())


def cache_info(index: DataFrame) -> DataFrame:
    """Number of entries, files and samples."""
    return index.agg(
        F.count(F.lit(1)).alias("entries"),
        F.coalesce(F.sum(F.size("files")), F.lit(0)).cast("bigint").alias("files"),
        F.coalesce(F.sum("num_samples"), F.lit(0)).alias("total_samples"),
    )
