"""Binary files under the shared folder, written and read from tasks through a file-system URI."""

from __future__ import annotations

import pyarrow.fs as pafs


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; Hadoop's ``s3a``/``s3n`` are object stores like ``s3``."""
    for scheme in ("s3a://", "s3n://"):
        if uri.startswith(scheme):
            uri = "s3://" + uri[len(scheme) :]
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def open_output(uri: str):
    fs, path = locate(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path)


def open_input(uri: str):
    fs, path = locate(uri)
    return fs.open_input_file(path)
