"""Files written once: objects and previews under content-derived names, and exports outside the workspace."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame

from .store import StoreError, object_path, safe_name


def _put(folder: str, rel_path: str, content: bytes) -> None:
    if ".." in rel_path.split("/") or rel_path.startswith("/"):
        raise StoreError(f"unsafe path {rel_path!r}")
    path = os.path.join(folder, rel_path)
    if os.path.exists(path):
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "wb") as f:
        f.write(content)
    os.replace(beside, path)


def write_objects(df: DataFrame, folder: str) -> None:
    """Write (rel_path, content) below a folder that all executors mount. A file that is there stays; a new one is written
    beside its place and renamed, so that a task that runs twice, or two tasks with one object, leave one whole file."""

    def part(rows) -> None:
        for r in rows:
            _put(folder, r.rel_path, r.content)

    df.select("rel_path", "content").foreachPartition(part)


def stored(df: DataFrame, folder: str) -> DataFrame:
    """``df`` (content, mime_type, ...) with byte_size, sha256 and rel_path in place of the content, which the tasks that
    read the result write as objects: files are neither made twice nor sent to the driver."""
    rest = [c for c in df.columns if c != "content"]

    def run(batches):
        for b in batches:
            contents, mimes = b.column("content").to_pylist(), b.column("mime_type").to_pylist()
            digests = [hashlib.sha256(c).hexdigest() for c in contents]
            paths = [object_path(d, m) for d, m in zip(digests, mimes, strict=True)]
            for path, content in zip(paths, contents, strict=True):
                _put(folder, path, content)
            more = [pa.array([len(c) for c in contents], pa.int64()), pa.array(digests, pa.string()), pa.array(paths, pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *more], [*rest, "byte_size", "sha256", "rel_path"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "content")
    return df.mapInArrow(run, f"{schema}, byte_size long, sha256 string, rel_path string")


def put(df: DataFrame, folder: str) -> DataFrame:
    """``df`` (rel_path, content, ...) without the content, which the tasks that read the result write."""
    rest = [c for c in df.columns if c != "content"]

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("rel_path").to_pylist(), b.column("content").to_pylist(), strict=True):
                _put(folder, path, content)
            yield b.select(rest)

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "content"))


def preview_path(key: str, extension: str) -> str:
    return f"previews/{safe_name(key)}.{safe_name(extension)}"


def export_file(source: str, target: str, workspace: str, overwrite: bool = False) -> str:
    """Copy a file out of the workspace, links resolved; never into it, over a folder, or over a file unless told so."""
    real, inside = os.path.realpath(target), os.path.realpath(workspace)
    if os.path.commonpath([real, inside]) == inside:
        raise StoreError("exports must leave the workspace")
    if os.path.isdir(real):
        raise StoreError("the target is a folder")
    if not os.path.isdir(os.path.dirname(real)):
        raise StoreError("the target's folder does not exist")
    if os.path.exists(real) and not overwrite:
        raise StoreError("the target exists")
    return shutil.copyfile(source, real)
