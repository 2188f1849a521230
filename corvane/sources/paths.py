"""Files by path, on a mounted folder or behind another file system."""

import os


def plain(path: str) -> str | None:
    """The path on a mounted folder, or None for one behind another file system."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def open_path(path: str, mode: str):
    local = plain(path)
    if local is not None:
        return open(local, mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner) if mode == "rb" else store.open_output_stream(inner)


def move(src: str, dst: str) -> None:
    local = plain(src)
    if local is not None:
        os.replace(local, plain(dst))
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(src)
    store.move(inner, fs.FileSystem.from_uri(dst)[1])


def make_folder(path: str) -> None:
    local = plain(path)
    if local is not None:
        os.makedirs(local, exist_ok=True)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(inner, recursive=True)
