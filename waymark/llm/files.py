"""Files in the shared folder, by the URI that Spark uses for it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{uri}")


@contextmanager
def writing(uri: str) -> Iterator:
    """A stream that becomes the file ``uri`` only once it is whole.

    A task that is run again or twice at once replaces the file by an equal one.
    """
    files, path = _open(uri)
    folder, _, name = path.rpartition("/")
    files.create_dir(folder, recursive=True)
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(own, compression=None) as out:
        yield out
    files.move(own, path)


def reading(uri: str):
    files, path = _open(uri)
    return files.open_input_stream(path, compression=None)
