"""Whole files written from executors: under a temporary name first, then moved to a name that only depends on the data, so that a lost or repeated task leaves the same files. The folder may be in any store that pyarrow knows (file, hdfs, s3)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def put(folder: str, name: str, data: bytes) -> None:
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(f"{path}/_temporary", recursive=True)
    tmp = f"{path}/_temporary/{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(tmp, compression=None) as f:
        f.write(data)
    store.move(tmp, f"{path}/{name}")


def get(path: str) -> bytes:
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at, compression=None) as f:
        return f.read()


def find(path: str) -> bytes | None:
    """What get() returns, or None where there is no such file."""
    store, at = fs.FileSystem.from_uri(path)
    return get(path) if store.get_file_info(at).type == fs.FileType.File else None


def create(folder: str):
    """A new file in the folder under a name of its own: its address and a stream to write to. What an attempt that failed
    leaves there is named by no row, and goes with the folder."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    name = uuid.uuid4().hex
    return f"{folder}/{name}", store.open_output_stream(f"{path}/{name}", compression=None)


def parts(path: str, spans: list[tuple[int, int]]) -> list[bytes]:
    """The bytes of each (offset, length) of a file."""
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        return [f.read_at(length, offset) for offset, length in spans]
