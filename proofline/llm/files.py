"""Binary files that executors write to, and read from, the shared folder.

A file's name is new with each attempt, and only the rows a task returns name
its files: those of failed or repeated attempts are never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from proofline.llm.common import shared_dir


def output_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def write_file(folder: str, stem: str, content: bytes) -> str:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}"
    with system.open_output_stream(f"{path}/{name}") as f:
        f.write(content)
    return f"{folder}/{name}"


def read_file(uri: str) -> bytes:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as f:
        return f.read()
