"""Opening files in the shared folder from executors, whatever its file system (file, hdfs, s3, ...)."""

from __future__ import annotations

import re


def _at(uri: str):
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+.-]*:", uri):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return fs.LocalFileSystem(), uri


def open_write(uri: str):
    system, path = _at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_read(uri: str):
    """Seekable."""
    system, path = _at(uri)
    return system.open_input_file(path)


def open_stream(uri: str):
    """Sequential, raw bytes."""
    system, path = _at(uri)
    return system.open_input_stream(path, compression=None)
