"""Binary files in the shared folder, written and read by tasks through Arrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder URI as Spark writes it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


class TaskFiles:
    """Files of one task attempt. Their names are new for each attempt, and only files named in a finished task's rows
    count, so a repeated or lost attempt leaves nothing that a reader would see."""

    def __init__(self, folder: str, suffix: str):
        self.system, self.folder = at(folder)
        self.system.create_dir(self.folder, recursive=True)
        self.prefix, self.suffix, self.made = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:10]}", suffix, 0

    def open(self):
        """(name, stream) of the next file."""
        name = f"{self.prefix}-{self.made:04d}{self.suffix}"
        self.made += 1
        # Without this, a name that ends in .gz would compress the stream once more.
        return name, self.system.open_output_stream(f"{self.folder}/{name}", compression=None)
