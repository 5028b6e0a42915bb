"""Files from Python workers, on any file system that they can reach."""

from __future__ import annotations

import json
from urllib.parse import quote, unquote

from pyarrow import fs


def open_path(path: str):
    """A seekable binary stream."""
    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        return open("/" + unquote(rest or scheme).lstrip("/"), "rb")
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's place in it."""
    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        return fs.LocalFileSystem(), "/" + unquote(rest or scheme).strip("/")
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/")


def address(system: fs.FileSystem, root: str, inner: str) -> str:
    """How Spark writes the address of a file found under ``root``."""
    if isinstance(system, fs.LocalFileSystem):
        return "file:" + quote(inner)
    return root[: len(root.rstrip("/")) - len(locate(root)[1])] + inner


def plain_address(system: fs.FileSystem, root: str, inner: str) -> str:
    """How Spark's readers are told of a file under ``root``: they take a path as it is, signs that addresses encode included."""
    return "file:" + inner if isinstance(system, fs.LocalFileSystem) else address(system, root, inner)


def files_in(path: str, recursive: bool = False) -> list[str]:
    """Addresses of the files in a folder; a folder that is not there has none."""
    system, inner = locate(path)
    found = system.get_file_info(fs.FileSelector(inner, recursive=recursive, allow_not_found=True))
    return sorted(address(system, path, f.path) for f in found if f.is_file)


def write_new(path: str, name: str, content: dict) -> None:
    """A small JSON file that appears whole or not at all, and never replaces another one."""
    system, inner = locate(path)
    system.create_dir(inner, recursive=True)
    if isinstance(system, fs.LocalFileSystem):
        import os
        import uuid

        draft = f"{inner}/.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as out:
            json.dump(content, out)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(draft, f"{inner}/{name}")  # fails if the name is taken
        finally:
            os.unlink(draft)
        return
    if system.get_file_info(f"{inner}/{name}").type != fs.FileType.NotFound:
        raise FileExistsError(f"{path}/{name}")
    with system.open_output_stream(f"{inner}/{name}") as out:  # object stores show a file once it is closed
        out.write(json.dumps(content).encode())


def read_json(path: str) -> dict:
    with open_path(path) as stream:
        return json.loads(stream.read())
