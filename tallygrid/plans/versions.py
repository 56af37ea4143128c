"""Sets of data that readers see as a whole: folders that never change, a manifest that names them, and one pointer.

A set has named parts, each in one folder or file below the set's own folder. A manifest lists them and is never changed
either; ``_current`` holds the number of the manifest that counts. Publishing writes the new data first, then a manifest
under the next number, then replaces the pointer by a single rename. Whatever fails before that leaves the set as it was.
Who took the same number sooner wins: a manifest is only ever created, so the later of two writers fails and changes
nothing. A writer that dies between manifest and pointer leaves its number taken, until ``abandon`` is called.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import SparkSession

POINTER = "_current"


def _manifest(number: int) -> str:
    return f"_manifest-{number:08d}.json"


class Versions:
    """The parts of the set in a directory, which may be on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._settings = spark._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(self._settings)

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.directory}/{name}" if name else self.directory)

    def _read(self, name: str) -> str | None:
        path = self._path(name)
        if not self._files.exists(path):
            return None
        stream = self._files.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> None:
        if self._files.exists(self._path(name)):
            raise FileExistsError(f"{self.directory}/{name}")
        # Of two at the same time the file system lets one through.
        stream = self._files.create(self._path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def number(self) -> int:
        """That of the manifest that counts, 0 before the first."""
        return int(self._read(POINTER) or 0)

    def parts(self) -> dict[str, str]:
        """The path of each part."""
        number = self.number()
        listed = json.loads(self._read(_manifest(number))) if number else {}
        return {name: f"{self.directory}/{place}" for name, place in listed.items()}

    def folder(self) -> str:
        """The name of a new folder for data, below the directory."""
        return f"data-{uuid.uuid4().hex}"

    def partitions(self, folder: str) -> list[str]:
        """The names of the partitions written to a folder."""
        path = self._path(folder)
        found = [status.getPath().getName() for status in self._files.listStatus(path)] if self._files.exists(path) else []
        return sorted(name for name in found if "=" in name)

    def publish(self, changed: Mapping[str, str | None], after: int, replace: bool = False) -> None:
        """Let the changed parts, by name with their place below the directory or None for those that are gone, take effect
        at once. ``after`` is the number of the set that they were made from; with ``replace`` parts not named go."""
        listed = {} if replace else {name: path.removeprefix(f"{self.directory}/") for name, path in self.parts().items()}
        listed |= changed
        if self.number() != after:
            raise OSError(f"the set was published by another: it is at {self.number()}, not at {after}")
        self._create(_manifest(after + 1), json.dumps({k: v for k, v in sorted(listed.items()) if v is not None}))
        self._point(after + 1)

    def abandon(self) -> None:
        """Give free the number of a writer that died before its set took effect."""
        self._files.delete(self._path(_manifest(self.number() + 1)), False)

    def _point(self, number: int) -> None:
        name = f"{POINTER}-{uuid.uuid4().hex}"
        self._create(name, str(number))
        self.rename(name, POINTER)

    def rename(self, name: str, to: str) -> None:
        """Rename a file below the directory, in place of one that is there."""
        context = self._hadoop.FileContext.getFileContext(self._files.getUri(), self._settings)
        kind = getattr(self._hadoop, "Options$Rename")
        overwrite = self.spark._sc._gateway.new_array(kind, 1)
        overwrite[0] = kind.OVERWRITE
        context.rename(self._files.makeQualified(self._path(name)), self._files.makeQualified(self._path(to)), overwrite)

    def sweep(self) -> list[str]:
        """Delete folders of data that the set no longer has; for when no reader of an older one is left."""
        used = {path.removeprefix(f"{self.directory}/").split("/")[0] for path in self.parts().values()}
        gone = []
        for status in self._files.listStatus(self._path("")):
            name = status.getPath().getName()
            if name.startswith("data-") and name not in used:
                self._files.delete(status.getPath(), True)
                gone.append(name)
        return gone
