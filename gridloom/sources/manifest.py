"""Versions of a folder's state: a small JSON file each, of which the newest counts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifest:
    """One writer at a time; a version is published whole or not at all."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def at(self, place: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(place)

    def fs(self):
        return self.at(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        """What a folder holds; nothing if it isn't there."""
        fs = self.fs()
        return [f.getPath().getName() for f in fs.listStatus(self.at(folder))] if fs.exists(self.at(folder)) else []

    def read(self) -> dict | None:
        """The newest version, None if there is none."""
        versions = sorted(int(n.removesuffix(".json")) for n in self.names(self.folder) if n.endswith(".json"))
        if not versions:
            return None
        stream = self.fs().open(self.at(f"{self.folder}/{versions[-1]:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, state: dict) -> None:
        """state["version"] says which version it is: written beside its place, then renamed."""
        fs, target = self.fs(), self.at(f"{self.folder}/{state['version']:012d}.json")
        if fs.exists(target):
            raise RuntimeError(f"another writer has made version {state['version']} of {self.folder}")
        beside = self.at(f"{self.folder}/{uuid.uuid4().hex}.new")
        out = fs.create(beside, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(beside, target):
            raise RuntimeError(f"version {state['version']} of {self.folder} could not be published")

    def delete(self, places: list[str]) -> None:
        for place in places:
            self.fs().delete(self.at(place), True)
