"""Places all executors share, and sorted hash arrays there that workers map into memory."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_opened: dict[tuple[str, int, str], np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only where it is unset and Spark runs in one process, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders named while :func:`finished` runs.
_named: list[list[str]] = []


def new_dir(spark: SparkSession, name: str) -> str:
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _named:
        _named[-1].append(at)
    return at


def finished(spark: SparkSession, make: Callable[[], DataFrame], name: str, *done: str) -> tuple[DataFrame, str]:
    """The rows that ``make`` gives, written, and their folder. The folders that were used on the way go, and so do those in ``done``."""
    at, used = new_dir(spark, name), []
    _named.append(used)
    try:
        df = make()
        df.write.parquet(at)
    finally:
        _named.pop()
    remove(spark, *used, *done)
    return spark.read.schema(df.schema).parquet(at), at


def checkpoint(df: DataFrame) -> DataFrame:
    """Rows in the shared folder; lineage ends there, and lost executors lose nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, name: str = "rows") -> DataFrame:
    """Like :func:`checkpoint`, but as compressed Parquet."""
    spark = df.sparkSession
    at = new_dir(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def remove(spark: SparkSession, *uris: str) -> None:
    """Delete folders that nothing reads any more; those that are gone already don't matter."""
    for uri in uris:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """A folder for what one operator writes on its way; :meth:`clear` deletes it once nothing lazy reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, new_dir(spark, name)

    def dir(self, name: str) -> str:
        return f"{self.at}/{name}-{uuid.uuid4().hex[:8]}"

    def saved(self, df: DataFrame, name: str = "rows") -> DataFrame:
        at = self.dir(name)
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def clear(self) -> None:
        remove(self.spark, self.at)


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def put(uri: str, shard: int, arrays: dict[str, np.ndarray]) -> None:
    """Write a shard's arrays. A retried or repeated task writes the same bytes, and a rename shows only whole files."""
    local = _local(uri)
    for name, array in arrays.items():
        out = io.BytesIO()
        np.save(out, array)
        if local:
            os.makedirs(local, exist_ok=True)
            part = f"{local}/.{shard}.{name}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(out.getbuffer())
            os.replace(part, f"{local}/{shard}.{name}.npy")
        else:
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(uri)
            system.create_dir(path, recursive=True)
            with system.open_output_stream(f"{path}/.{shard}.{name}.{(part := uuid.uuid4().hex)}") as f:
                f.write(out.getvalue())
            system.move(f"{path}/.{shard}.{name}.{part}", f"{path}/{shard}.{name}.npy")


def seal(uri: str, shards: int, written: Iterable[int], *names: str) -> None:
    """Say which shards of these arrays were written, once all are: others are empty, and one that is missing later is an error."""
    absent = np.setdiff1d(np.arange(shards), np.fromiter(written, np.int64))
    put(uri, -1, {f"absent-{name}": absent for name in names})


def _open(uri: str, shard: int, name: str) -> np.ndarray | None:
    if local := _local(uri):
        path = f"{local}/{shard}.{name}.npy"
        return np.asarray(np.load(path, mmap_mode="r")) if os.path.exists(path) else None
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    info = system.get_file_info(f"{path}/{shard}.{name}.npy")
    if info.type == fs.FileType.NotFound:
        return None
    with tempfile.TemporaryFile() as copy, system.open_input_stream(info.path) as f:
        while block := f.read(1 << 22):
            copy.write(block)
        copy.seek(0)
        version = np.lib.format.read_magic(copy)
        shape, _, kind = np.lib.format.read_array_header_1_0(copy) if version == (1, 0) else np.lib.format.read_array_header_2_0(copy)
        return np.asarray(np.memmap(copy, kind, "r", copy.tell(), shape)) if shape[0] else np.empty(0, kind)


def get(uri: str, shard: int, name: str) -> np.ndarray:
    """A shard's array, mapped where the shared folder is mounted, else copied once for each worker; empty for a shard that
    nothing was written for, as :func:`seal` has it. Any other missing array raises."""
    key = (uri, shard, name)
    if key not in _opened:
        if len(_opened) > 4096 or any(k[0] != uri for k in _opened):
            for k in [k for k in _opened if k[0] != uri or len(_opened) > 4096]:
                del _opened[k]
        found = _open(uri, shard, name)
        if found is None:
            if shard < 0 or shard not in get(uri, -1, f"absent-{name}"):
                raise FileNotFoundError(f"{uri}: no array {name} of shard {shard}")
            found = np.empty(0, np.uint64)
        _opened[key] = found
    return _opened[key]


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    if not len(sorted_keys):
        return np.empty(0, np.int64)
    new = np.empty(len(sorted_keys), bool)
    new[0] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:])
    return np.flatnonzero(new)


def find(keys: np.ndarray, sorted_queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the queries among sorted keys, and which of them are there."""
    if not len(keys):
        return np.zeros(len(sorted_queries), np.int64), np.zeros(len(sorted_queries), bool)
    at = np.searchsorted(keys, sorted_queries)
    at[at == len(keys)] = 0
    return at, keys[at] == sorted_queries
