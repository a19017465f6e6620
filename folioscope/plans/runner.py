"""A runner of stages that keeps what each one has made: after a crash it goes on where it was.

A stage's output is a version of a table below the run's folder, and counts once committed. A stage that fails softly leaves its
error in the manifest; stages that need its output are skipped, all others go on, and a later run tries it again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.versions import Versions

MANIFEST = T.StructType([T.StructField("stage", T.StringType()), T.StructField("status", T.StringType()), T.StructField("n_rows", T.LongType()), T.StructField("error", T.StringType())])


@dataclass(frozen=True)
class Stage:
    """``make`` gets the outputs of the stages that it ``needs``, by name, and returns a table of ``schema``."""

    name: str
    schema: T.StructType
    make: Callable[[dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    soft: bool = True


class Runner:
    """Runs stages in their given order below ``path``."""

    def __init__(self, spark: SparkSession, path: str, stages: list[Stage]):
        seen: set[str] = set()
        for s in stages:
            if s.name in seen or not set(s.needs) <= seen:
                raise ValueError(f"stage {s.name} is repeated, or needs one that does not come before it")
            seen.add(s.name)
        self.spark, self.path, self.stages = spark, path.rstrip("/"), stages

    def output(self, stage: Stage) -> DataFrame | None:
        """What the stage has committed; None if it has not."""
        versions = Versions(self.spark, f"{self.path}/{stage.name}", stage.schema)
        done = versions.complete()
        return versions.read(done[-1]) if done else None

    def run(self) -> DataFrame:
        """Run what is not done yet; (stage, status, n_rows, error) of each stage: done before, done, failed or skipped."""
        outputs: dict[str, DataFrame] = {}
        rows: list[tuple] = []
        for s in self.stages:
            kept = self.output(s)
            lacking = [n for n in s.needs if n not in outputs]
            status, error = "done before", None
            if kept is None and lacking:
                status, error = "skipped", f"needs {', '.join(lacking)}"
            elif kept is None:
                try:
                    Versions(self.spark, f"{self.path}/{s.name}", s.schema).write(s.make({n: outputs[n] for n in s.needs}), 1)
                    status, kept = "done", self.output(s)
                except Exception as e:  # one step's failure must not end the run
                    if not s.soft:
                        raise
                    status, error = "failed", f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
            if kept is not None:
                outputs[s.name] = kept
            rows.append((s.name, status, kept.count() if kept is not None else None, error))
        return self.spark.createDataFrame(rows, MANIFEST)
