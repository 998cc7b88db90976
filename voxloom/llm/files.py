"""Files that tasks write to and read from the shared folder, by any URI that pyarrow knows (file, hdfs, s3, gs)."""

from __future__ import annotations

from contextlib import contextmanager

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; Hadoop writes file:/path where others write file:///path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


@contextmanager
def writing(uri: str):
    """A stream to a new file. Each attempt of a task takes a new name; only names in the table that Spark commits are read."""
    store, path = at(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        yield out


@contextmanager
def reading(uri: str):
    """A file for range reads: read_at(n, offset) and size()."""
    store, path = at(uri)
    with store.open_input_file(path) as f:
        yield f
