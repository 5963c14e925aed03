"""Binary files in the shared folder, opened by Arrow's file systems from tasks and driver alike."""

from __future__ import annotations

import re

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a Hadoop-style URI; a plain path is local to the shared mount."""
    if re.match(r"file:/+", uri):
        uri = "/" + re.sub(r"^file:/+", "", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def writer(uri: str):
    system, path = resolve(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)  # the bytes as they are, whatever the name


def reader(uri: str):
    """A seekable file."""
    system, path = resolve(uri)
    return system.open_input_file(path)
