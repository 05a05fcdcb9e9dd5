"""Scratch folders that driver and executors share; they go when the process that made them ends."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own_root: str | None = None
_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where that is unset, but only on a local master."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="logmill-")
        atexit.register(shutil.rmtree, _own_root, True)
    return f"file://{_own_root}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared root (not created yet)."""
    if not _made:
        atexit.register(_clear)
    _made.append(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def discard(*paths: str) -> None:
    """Delete folders that ``new_folder`` named, where they exist."""
    for path in paths:
        try:
            fs, local = file_system(path)
            fs.delete_dir(local)
        except (OSError, ValueError):
            pass  # never written, gone already, or in a store that only Spark reads
        if path in _made:
            _made.remove(path)


def _clear() -> None:
    discard(*_made[:])


def file_system(uri: str):
    """``(filesystem, path)`` for reading and writing raw bytes on driver and executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
