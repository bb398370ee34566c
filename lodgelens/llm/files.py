"""Whole files in the shared folder, written and read inside tasks."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import TaskContext


def filesystem(uri: str):
    """(file system, path) of a folder or file name that may lack a scheme."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri else uri if uri.startswith("file:") else f"file://{uri}")


@contextmanager
def new_file(uri: str, name: str):
    """A stream to ``uri``/``name``. The file appears there by a rename when
    all is written, so a repeated task replaces it by the same bytes."""
    system, folder = filesystem(uri)
    system.create_dir(folder, recursive=True)
    context = TaskContext.get()
    part = f"{folder}/_part-{name}-{context.taskAttemptId() if context else 0}"
    with system.open_output_stream(part) as out:
        yield out
    system.move(part, f"{folder}/{name}")
