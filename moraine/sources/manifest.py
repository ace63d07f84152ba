"""The manifest: which runs and which log batches make up a store, as numbered immutable versions.

A commit writes version n + 1 only if no one else has: of two writers one fails and may retry on what the other left.  Readers
use the highest version, so a crash at any point leaves the version before it.  One record for each run and unflushed batch: metadata.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from moraine.plans.picking import Run
from moraine.schemas import MANIFEST
from moraine.sources import paths


@dataclass(frozen=True)
class RunFile:
    file: str
    level: int
    file_seq: int
    n_entries: int
    n_deleted: int
    lo: str
    hi: str
    bytes: int

    def as_run(self) -> Run:
        return Run(self.file_seq, self.level, self.lo, self.hi)


@dataclass(frozen=True)
class Batch:
    """One append to the log: its path and its range of sequence numbers."""

    path: str
    first: int
    last: int
    bytes: int


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    next_seq: int = 0
    next_file_seq: int = 1
    runs: tuple[RunFile, ...] = ()
    tail: tuple[Batch, ...] = ()  # unflushed
    major_next: dict = field(default_factory=dict)  # by level
    streams: dict = field(default_factory=dict)  # last batch taken in of each named stream

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Manifest:
        x = json.loads(text)
        runs, tail = tuple(RunFile(**r) for r in x["runs"]), tuple(Batch(**b) for b in x["tail"])
        return Manifest(**x | {"runs": runs, "tail": tail, "major_next": {int(k): v for k, v in x["major_next"].items()}})


class ConflictError(RuntimeError):
    """Another writer committed first."""


class ManifestLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, f"{root}/manifest"
        paths.make_dir(spark, self.root)

    def versions(self) -> list[int]:
        return sorted(int(n[2:-5]) for n in paths.names(self.spark, self.root) if n.startswith("v=") and n.endswith(".json") and n[2:-5].isdigit())

    def load(self) -> Manifest:
        have = self.versions()
        return Manifest.from_json(paths.read_text(self.spark, f"{self.root}/v={have[-1]:012d}.json")) if have else Manifest()

    def commit(self, new: Manifest, keep: int = 10) -> Manifest:
        """Publishes ``new`` as the version after the one it was made from; ConflictError if there is one already."""
        new = replace(new, version=new.version + 1)
        if not paths.create_new(self.spark, f"{self.root}/v={new.version:012d}.json", new.to_json()):
            raise ConflictError(f"version {new.version} is there already")
        for v in self.versions()[:-keep]:
            paths.delete_path(self.spark, f"{self.root}/v={v:012d}.json")
        return new


def as_table(spark: SparkSession, manifest: Manifest) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(r).values()) for r in manifest.runs], MANIFEST)
