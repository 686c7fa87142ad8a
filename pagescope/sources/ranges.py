"""Ranges of files, read where the task runs: local paths, http(s) and whatever pyarrow's file systems reach."""

from __future__ import annotations

import os
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Any, TypeVar
from urllib.parse import unquote, urlparse

from ..errors import CorruptFile, Shortfall

T = TypeVar("T")
#: First guess at the length of an index or a header.
GUESS, HEADER_GUESS = 64 << 10, 8 << 10
#: Least bytes of a request over http: what lies near is held, and near the end of a file all up to the end.
LEAST_REQUEST = 64 << 10


class Ranges:
    """One file. `reads` and `bytes_read` count what was asked for, `requests` what went over http."""

    def __init__(self, path: str, size: int | None = None):
        self.path, self.reads, self.bytes_read, self.requests = path, 0, 0, 0
        self._file: Any = None
        self._held, self._held_at = b"", 0
        url = urlparse(path)
        if url.scheme in ("http", "https"):
            self._read, self.size = self._http, size if size is not None else self._http_size()
        elif url.scheme in ("", "file"):
            self._file = open(unquote(url.path) if url.scheme else path, "rb")  # noqa: SIM115
            self._read, self.size = self._seek, os.fstat(self._file.fileno()).st_size
        else:
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(path)
            self._file = system.open_input_file(inner)
            self._read, self.size = self._seek, self._file.size()

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_: object) -> None:
        if self._file is not None:
            self._file.close()

    def _seek(self, at: int, size: int) -> bytes:
        self._file.seek(at)
        return self._file.read(size)

    def _http_size(self) -> int:
        with urllib.request.urlopen(urllib.request.Request(self.path, method="HEAD")) as answer:  # noqa: S310
            if answer.headers.get("Content-Length") is None:
                raise OSError(f"{self.path} doesn't tell its length")
            return int(answer.headers["Content-Length"])

    def _http(self, at: int, size: int) -> bytes:
        end = at + size
        if not size:
            return b""
        if not self._held_at <= at <= end <= self._held_at + len(self._held):
            start = max(0, min(at, self.size - LEAST_REQUEST)) if self.size - at <= LEAST_REQUEST else at
            stop = min(self.size, max(end, start + LEAST_REQUEST))
            asked = urllib.request.Request(self.path, headers={"Range": f"bytes={start}-{stop - 1}"})  # noqa: S310
            with urllib.request.urlopen(asked) as answer:  # noqa: S310
                self._held = answer.read() if answer.status == 206 else answer.read()[start:stop]
            self._held_at = start
            self.requests += 1
        return self._held[at - self._held_at : end - self._held_at]

    def read(self, at: int, size: int) -> bytes:
        """data[at:at+size]; less only at the end of the file."""
        if at < 0 or size < 0:
            raise CorruptFile(f"a range of {size} bytes at {at}")
        found = self._read(at, min(size, max(0, self.size - at)))
        self.reads += 1
        self.bytes_read += len(found)
        return found

    def exactly(self, at: int, size: int) -> bytes:
        found = self.read(at, size)
        if len(found) < size:
            raise CorruptFile(f"{len(found)} of {size} bytes at {at}")
        return found

    def span(self, at: int, parse: Callable[[bytes, int], T], guess: int = GUESS, length: int | None = None) -> T:
        """parse(bytes, at) of a record of unknown length: reads a guess, and where the record goes on, what it is
        known to miss or as much again, only the new part each time, up to the end of the file."""
        if length is not None:
            return parse(self.exactly(at, length), at)
        held = self.read(at, guess)
        while True:
            try:
                return parse(held, at)
            except Shortfall as short:
                more = self.read(at + len(held), max(short.missing, len(held)))
                if not more:
                    raise CorruptFile(f"the record at {at} goes on after the end of the file") from short
                held += more
