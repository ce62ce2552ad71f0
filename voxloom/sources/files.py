"""Files and folders of any file system Arrow knows (local disks, HDFS, object stores), by path or address."""

from __future__ import annotations

import os
import re

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there. Addresses may have Spark's form file:/a/b."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def kind(path: str) -> str:
    """'file', 'folder' or 'none'."""
    system, at = located(path)
    return {fs.FileType.File: "file", fs.FileType.Directory: "folder"}.get(system.get_file_info(at).type, "none")


def below(path: str, ending: str) -> list[str]:
    """The files of an ending anywhere below a folder, sorted, in the form the folder was given in."""
    system, at = located(path)
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    cut = len(at.rstrip("/"))
    return sorted(path.rstrip("/") + i.path[cut:] for i in found if i.type == fs.FileType.File and i.path.endswith(ending))


def write_bytes(path: str, data: bytes) -> None:
    """A file with its folders; readers see the old file or the new one."""
    system, at = located(path)
    system.create_dir(os.path.dirname(at), recursive=True)
    with system.open_output_stream(f"{at}.part") as f:
        f.write(data)
    system.move(f"{at}.part", at)


def read_bytes(path: str) -> bytes:
    system, at = located(path)
    with system.open_input_stream(at) as f:
        return f.read()
