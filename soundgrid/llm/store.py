"""Array files in the folder that the cluster shares: written whole, mapped into memory by readers."""
from __future__ import annotations

import hashlib
import io
import json
import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np


def new_folder(spark, kind: str) -> str:
    from soundgrid.session import shared_folder

    return f"{shared_folder(spark).rstrip('/')}/soundgrid-{kind}-{uuid.uuid4().hex}"


class Store:
    """Files of one folder, on a local mount (mapped where they lie) or in a remote store (fetched once per worker, then mapped)."""

    def __init__(self, uri: str):
        self.uri, parts = uri, urlparse(uri)
        self.local = parts.path if parts.scheme in ("", "file") else None

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def write(self, name: str, data: bytes) -> None:
        """Puts the file under its name in one step, so that a task that runs twice leaves one whole file."""
        part = f".{name}.{uuid.uuid4().hex}"
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            with open(f"{self.local}/{part}", "wb") as f:
                f.write(data)
            os.replace(f"{self.local}/{part}", f"{self.local}/{name}")
            return
        system, path = self._remote()
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{part}") as f:
            f.write(data)
        system.move(f"{path}/{part}", f"{path}/{name}")

    def path(self, name: str) -> str:
        """A local path of the file."""
        if self.local is not None:
            return f"{self.local}/{name}"
        here = f"{tempfile.gettempdir()}/{hashlib.sha256(self.uri.encode()).hexdigest()[:24]}"
        if not os.path.exists(f"{here}/{name}"):
            os.makedirs(here, exist_ok=True)
            system, path = self._remote()
            part = f"{here}/.{name}.{uuid.uuid4().hex}"
            with system.open_input_stream(f"{path}/{name}") as source, open(part, "wb") as f:
                while block := source.read(1 << 22):
                    f.write(block)
            os.replace(part, f"{here}/{name}")
        return f"{here}/{name}"

    def save(self, name: str, array: np.ndarray) -> None:
        data = io.BytesIO()
        np.save(data, array)
        self.write(f"{name}.npy", data.getvalue())

    def load(self, name: str) -> np.ndarray:
        return np.load(self.path(f"{name}.npy"), mmap_mode="r")

    def save_all(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        """Several arrays in one file: a line that lists them, then each at a multiple of eight bytes."""
        listed, body, at = {}, [], 0
        for key, a in arrays.items():
            data = np.ascontiguousarray(a).tobytes()
            listed[key] = (a.dtype.str, len(a), at)
            body.append(data + bytes(-len(data) % 8))
            at += len(body[-1])
        head = json.dumps(listed).encode()
        head += b" " * (-(len(head) + 1) % 8) + b"\n"
        self.write(f"{name}.arrays", head + b"".join(body))

    def load_all(self, name: str) -> dict[str, np.ndarray]:
        path = self.path(f"{name}.arrays")
        with open(path, "rb") as f:
            head = f.readline()
        whole = np.memmap(path, np.uint8, "r")
        out = {}
        for key, (kind, n, at) in json.loads(head).items():
            start = len(head) + at
            out[key] = np.asarray(whole[start : start + n * np.dtype(kind).itemsize]).view(kind)
        return out


def packed(*arrays: np.ndarray) -> bytes:
    import zstandard

    data = io.BytesIO()
    for a in arrays:
        np.save(data, a)
    return zstandard.ZstdCompressor(level=1).compress(data.getvalue())


def unpacked(data: bytes, count: int) -> list[np.ndarray]:
    import zstandard

    source = io.BytesIO(zstandard.ZstdDecompressor().decompress(data))
    return [np.load(source) for _ in range(count)]


def planes(x: np.ndarray) -> np.ndarray:
    """The first bytes of all numbers, then the second ones, and so on: small numbers pack well so."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)


def unplanes(x: np.ndarray, kind) -> np.ndarray:
    return np.ascontiguousarray(x.T).view(kind).reshape(x.shape[1])
