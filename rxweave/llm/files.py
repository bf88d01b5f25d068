"""Files that tasks write and read in the shared folder, through pyarrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def write_file(folder: str, name: str, parts: list[bytes]) -> str:
    """Write parts to a new file and return its path.

    The name is new for each attempt: a retried or speculative task leaves a file behind that no manifest mentions, and
    readers take their paths from the manifest alone.
    """
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    system, local = fs.FileSystem.from_uri(path)
    system.create_dir(local.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(local) as out:
        for part in parts:
            out.write(part)
    return path


def open_file(path: str):
    """A seekable binary file."""
    system, local = fs.FileSystem.from_uri(path)
    return system.open_input_file(local)
