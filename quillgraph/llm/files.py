"""File access from executors by URI (file, hdfs, s3, ... whatever pyarrow.fs opens)."""

from __future__ import annotations

import json
import posixpath

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


class Folder:
    """One folder of an output: attempts write files of their own name, the manifest says which of them count."""

    MANIFEST = "_manifest.json"

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)

    def at(self, name: str) -> str:
        return posixpath.join(self.path, name)

    def create(self) -> None:
        self.fs.create_dir(self.path, recursive=True)

    def write(self, name: str):
        return self.fs.open_output_stream(self.at(name), compression=None, buffer_size=1 << 20)

    def read(self, name: str):
        return self.fs.open_input_file(self.at(name))

    def drop(self, names) -> None:
        for name in names:
            if self.fs.get_file_info(self.at(name)).type == fs.FileType.File:
                self.fs.delete_file(self.at(name))

    def publish(self, entries: list[dict]) -> None:
        """Write the manifest under another name, then rename it: readers see all of it or nothing."""
        self.create()
        with self.fs.open_output_stream(self.at(self.MANIFEST + ".tmp"), compression=None) as f:
            f.write(json.dumps(entries).encode())
        self.fs.move(self.at(self.MANIFEST + ".tmp"), self.at(self.MANIFEST))

    def entries(self) -> list[dict]:
        with self.read(self.MANIFEST) as f:
            return json.loads(f.read())
