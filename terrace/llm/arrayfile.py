"""Files of named arrays that workers map into memory."""

from __future__ import annotations

import json
import mmap
import os
import struct
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np


def pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    """One file image: a JSON head with names, types and places, then the arrays at multiples of 64 bytes."""
    head, body = {}, bytearray()
    for name, a in arrays.items():
        body.extend(b"\0" * (-len(body) % 64))
        head[name] = (a.dtype.str, a.shape, len(body))
        body += np.ascontiguousarray(a).tobytes()
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    return struct.pack("<Q", len(text)) + text + bytes(body)


def unpack_arrays(view: mmap.mmap | memoryview) -> dict[str, np.ndarray]:
    n = struct.unpack("<Q", view[:8])[0]
    return {name: np.frombuffer(view, dtype, int(np.prod(shape)), 8 + n + at).reshape(shape) for name, (dtype, shape, at) in json.loads(bytes(view[8 : 8 + n])).items()}


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file on this machine, memory-mapped."""
    with open(path, "rb") as f:
        return unpack_arrays(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def write_shared(uri: str, data: bytes) -> None:
    """Write whole or not at all: a second try of a task replaces the file by an equal one."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    partial = f"{path}.{uuid.uuid4().hex[:8]}"
    with files.open_output_stream(partial) as out:
        out.write(data)
    files.move(partial, path)


@contextmanager
def open_shared(uri: str) -> Iterator:
    """A file that a task writes piece by piece, under a name that no other try of it takes."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(path) as out:
        yield out


def map_shared(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file in the shared folder; from a store that can't be mapped, over a nameless copy."""
    return unpack_arrays(_mapped(uri))


def view_shared(uri: str) -> np.ndarray:
    """The bytes of a file in the shared folder, likewise."""
    return np.frombuffer(_mapped(uri), np.uint8)


def _mapped(uri: str) -> mmap.mmap:
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    if isinstance(files, fs.LocalFileSystem):
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    with tempfile.TemporaryFile() as copy, files.open_input_stream(path) as source:
        while part := source.read(1 << 22):
            copy.write(part)
        copy.flush()
        return mmap.mmap(copy.fileno(), os.fstat(copy.fileno()).st_size, access=mmap.ACCESS_READ)
