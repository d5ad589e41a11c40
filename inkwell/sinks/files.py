"""Binary rows as files, each with a description, put in their place as a whole.

A file is written beside its place and moved there when it is complete, so a reader never sees
half of one, and a task that runs again after a failure writes the same file once more. Folders
are addresses of any file system that pyarrow knows.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WRITTEN = "name string, path string, byte_size long, sha256 string, error string"


def _placed(system: fs.FileSystem, folder: str, name: str, content: bytes) -> None:
    system.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(content)
    system.move(part, f"{folder}/{name}")


def uploaded(files: DataFrame, folder: str) -> DataFrame:
    """`files` has name (a path below the folder) and content. WRITTEN of each, written as the plan
    runs; a file that is there already is replaced. Unsafe names and null content are errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            rows = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                unsafe = not name or name.startswith(("/", "\\")) or ".." in name.replace("\\", "/").split("/") or ":" in name
                if unsafe or content is None:
                    rows.append((name, None, None, None, "unsafe_name" if unsafe else "no_content"))
                    continue
                above, _, last = f"{root}/{name}".rpartition("/")
                _placed(system, above, last, content)
                rows.append((name, f"{above}/{last}", len(content), hashlib.sha256(content).hexdigest(), None))
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["name", "path", "byte_size", "sha256", "error"])

    return files.select("name", "content").mapInArrow(run, WRITTEN)


ARTIFACT = "artifact_id string, filename string, mime_type string, byte_size long, sha256 string, expires_at_epoch long"


def artifacts(files: DataFrame, folder: str, now: int, ttl_seconds: int) -> DataFrame:
    """`files` has artifact_id, filename, mime_type, content. Each becomes a folder of its own with
    the file and `metadata.json`, moved to its place when both are complete. ARTIFACT rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            rows = []
            for key, filename, mime, content in zip(*(batch.column(c).to_pylist() for c in ("artifact_id", "filename", "mime_type", "content"))):
                if not re.fullmatch(r"[0-9a-f]{32}", key or "") or content is None:
                    continue
                safe = re.sub(r"[^A-Za-z0-9._-]+", "-", filename or "").strip("-.") or "document.bin"
                said = {"artifact_id": key, "filename": safe, "mime_type": mime or "application/octet-stream", "byte_size": len(content), "sha256": hashlib.sha256(content).hexdigest(), "expires_at_epoch": now + max(ttl_seconds, 60)}
                stage = f"{root}/.{key}.{uuid.uuid4().hex}.tmp"
                _placed(system, stage, safe, content)
                _placed(system, stage, "metadata.json", json.dumps(said, separators=(",", ":"), sort_keys=True).encode())
                if system.get_file_info(f"{root}/{key}").type != fs.FileType.NotFound:
                    system.delete_dir(f"{root}/{key}")
                system.move(stage, f"{root}/{key}")
                rows.append(tuple(said.values()))
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[c.split()[0] for c in ARTIFACT.split(", ")])

    return files.select("artifact_id", "filename", "mime_type", "content").mapInArrow(run, ARTIFACT)


def read_artifacts(wanted: DataFrame, folder: str) -> DataFrame:
    """`wanted` has artifact_id, byte_size, sha256. artifact_id, content, error: the file if it is
    there with that size and digest and its own description agrees, else `unavailable`."""

    def one(system: fs.FileSystem, root: str, key: str | None, size: int | None, digest: str | None) -> bytes | None:
        if not re.fullmatch(r"[0-9a-f]{32}", key or ""):
            return None
        try:
            with system.open_input_file(f"{root}/{key}/metadata.json") as f:
                said = json.loads(f.read())
            with system.open_input_file(f"{root}/{key}/{said['filename']}") as f:
                content = f.read()
        except (OSError, ValueError, KeyError):
            return None
        return content if len(content) == size and hashlib.sha256(content).hexdigest() == digest == said.get("sha256") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            keys = batch.column("artifact_id").to_pylist()
            found = [one(system, root, *r) for r in zip(keys, batch.column("byte_size").to_pylist(), batch.column("sha256").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(found, pa.binary()), pa.array([None if c is not None else "unavailable" for c in found], pa.string())], names=["artifact_id", "content", "error"]
            )

    return wanted.select("artifact_id", "byte_size", "sha256").mapInArrow(run, "artifact_id string, content binary, error string")


def remove_expired(described: DataFrame, folder: str, now: int) -> DataFrame:
    """`described` has ARTIFACT. artifact_id of the folders that have run out, removed as the plan
    runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            for key in batch.column(0).to_pylist():
                if re.fullmatch(r"[0-9a-f]{32}", key or "") and system.get_file_info(f"{root}/{key}").type != fs.FileType.NotFound:
                    system.delete_dir(f"{root}/{key}")
            yield batch

    return described.filter(F.col("expires_at_epoch") <= now).select("artifact_id").mapInArrow(run, "artifact_id string")


def prepared(requests: DataFrame, documents: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`requests` with the columns of the stored document of the same key where it has them, else
    their own; status stays that of the request."""
    theirs = documents.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    both = requests.join(theirs, key, "left")
    take: list[Column] = [F.coalesce(f"_{c}", c).alias(c) if c in columns and c != "status" else F.col(c) for c in requests.columns]
    return both.select(*take)
