"""Undo and redo of a sheet as a stored log of cell changes.

An edit is a small table of its cells with what they were and what they are. A version is the base and the edits up to it; reading
one takes, of each cell, the last value of these, in one scan of the edits and one of the base however many edits there are. Undo and
redo move the head; a new edit behind others cuts these off. Beyond `limit` edits the oldest become part of the base.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.coerce import text_to_number
from gridloom.operators.grid import CELLS
from gridloom.sources.manifest import Manifest

LIMIT = 60
_PLACE = ["sheet", "row", "col"]
_DELTA = "edit bigint, sheet string, row bigint, col int, before string, after string"


class CellHistory:
    """One writer at a time. Versions are named by numbers that never change: 0 is what `begin` got, an edit's version is one more than the last one made."""

    def __init__(self, spark: SparkSession, path: str, limit: int = LIMIT):
        self.spark, self.path, self.limit = spark, path.rstrip("/"), max(1, limit)
        self.states = Manifest(spark, f"{self.path}/states")

    def state(self) -> dict:
        """version (of the manifest), base (folder), base_version, edits (their versions, in order), head (how many of them count), last (the newest version ever made)."""
        state = self.states.read()
        if state is None:
            raise FileNotFoundError(f"{self.path} has no sheet yet: begin with one")
        return state

    def _publish(self, state: dict, **changes: object) -> None:
        self.states.publish(state | changes | {"version": state["version"] + 1})

    def begin(self, cells: DataFrame) -> None:
        base = self._write_base(cells)
        self.states.publish({"version": 0, "base": base, "base_version": 0, "edits": [], "head": 0, "last": 0})

    def _write_base(self, cells: DataFrame) -> str:
        base = f"base-{uuid.uuid4().hex}"
        cells.select("sheet", F.col("row").cast("bigint").alias("row"), F.col("col").cast("int").alias("col"), "text").write.parquet(f"{self.path}/{base}")
        return base

    def current(self) -> int:
        """The version at the head."""
        state = self.state()
        return state["edits"][state["head"] - 1] if state["head"] else state["base_version"]

    def versions(self) -> list[int]:
        """All that can be read, oldest first; those behind the head can be redone."""
        state = self.state()
        return [state["base_version"], *state["edits"]]

    def _upto(self, state: dict, version: int | None) -> list[int]:
        version = self.current() if version is None else version
        if version == state["base_version"]:
            return []
        if version not in state["edits"]:
            raise KeyError(f"version {version} was cut off or has become part of the base")
        return state["edits"][: state["edits"].index(version) + 1]

    def _deltas(self, edits: list[int]) -> DataFrame:
        return self.spark.read.schema(_DELTA).parquet(*(f"{self.path}/edit-{k}" for k in edits)) if edits else self.spark.createDataFrame([], _DELTA)

    def read(self, version: int | None = None) -> DataFrame:
        """The cells as of a version, by default the head's."""
        state = self.state()
        base = self.spark.read.schema("sheet string, row bigint, col int, text string").parquet(f"{self.path}/{state['base']}")
        deltas = self._deltas(self._upto(state, version)).select("edit", *_PLACE, F.col("after").alias("text"))
        rows = base.select(F.lit(-1).cast("bigint").alias("edit"), *_PLACE, "text").unionByName(deltas)
        # a removed cell has an empty text in its edit, so that it outlives what was there before
        last = rows.groupBy(*_PLACE).agg(F.max_by(F.coalesce("text", F.lit("")), "edit").alias("text")).where("text <> ''")
        return last.withColumn("num", text_to_number(F.col("text"))).select(*CELLS)

    def edit(self, values: DataFrame) -> int:
        """Set cells (sheet, row, col, text; an empty text removes one, of several for a cell the greatest counts); the new version. What could be redone can't be any more."""
        state = self.state()
        version = state["last"] + 1
        new = values.groupBy(*_PLACE).agg(F.max(F.coalesce("text", F.lit(""))).alias("after"))
        before = self.read().select(*_PLACE, F.col("text").alias("before"))
        rows = new.join(before, _PLACE, "left").select(F.lit(version).cast("bigint").alias("edit"), "sheet", F.col("row").cast("bigint").alias("row"), F.col("col").cast("int").alias("col"), "before", "after")
        rows.write.mode("overwrite").parquet(f"{self.path}/edit-{version}")  # what a writer left that died before it published
        edits = [*state["edits"][: state["head"]], version]
        self._publish(state, edits=edits, head=len(edits), last=version)
        if len(edits) > self.limit:
            self._compact()
        return version

    def _compact(self) -> None:
        """Edits beyond the limit become part of the base, as the list drops its oldest."""
        state = self.state()
        old = state["edits"][: len(state["edits"]) - self.limit]
        base = self._write_base(self.read(old[-1]))
        self._publish(state, base=base, base_version=old[-1], edits=state["edits"][len(old) :], head=state["head"] - len(old))

    def undo(self) -> bool:
        """One version back; False if there is none."""
        state = self.state()
        if not state["head"]:
            return False
        self._publish(state, head=state["head"] - 1)
        return True

    def redo(self) -> bool:
        state = self.state()
        if state["head"] == len(state["edits"]):
            return False
        self._publish(state, head=state["head"] + 1)
        return True

    def difference(self, old: int, new: int) -> DataFrame:
        """Cells that differ between two versions (the older one first): sheet, row, col, before, after. Only the edits between them are read."""
        state = self.state()
        between = [k for k in self._upto(state, new) if k not in self._upto(state, old)]
        ends = self._deltas(between).groupBy(*_PLACE).agg(F.min_by(F.coalesce("before", F.lit("")), "edit").alias("before"), F.max_by("after", "edit").alias("after"))
        return ends.where("before <> after")

    def vacuum(self) -> list[str]:
        """Delete what no version needs: cut-off edits and earlier bases. Not while an earlier version is being read."""
        state = self.state()
        needed = {state["base"], "states", *(f"edit-{k}" for k in state["edits"])}
        gone = sorted(n for n in self.states.names(self.path) if n not in needed)
        self.states.delete([f"{self.path}/{n}" for n in gone])
        return gone
