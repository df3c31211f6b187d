"""What an ingestion brings about: analyses of its project go, dashboard figures follow; a batch that is replayed changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import partials, tables
from ..operators.points import PointStore


def apply_ingests(analyses: PointStore, figures: PointStore, ingests: DataFrame, batch: int, stream: str = "ingests") -> None:
    """Take the analyses of ingested projects (project_id) out of the store and of the figures.

    Figures go first: if the second step breaks off, the replayed batch finds the
    figures done and the analyses still there.
    """
    if analyses.manifest()["streams"].get(stream, -1) >= batch:
        return
    projects = tables.written(ingests.select("project_id").filter(F.col("project_id").isNotNull()).distinct())
    gone = analyses.read().join(projects, "project_id", "left_semi")
    partials.take_in(figures, gone, stream, batch, sign=-1)
    analyses.remove(projects, "project_id", stream, batch)


def invalidate(ingests: DataFrame, analyses: PointStore, figures: PointStore, checkpoint: str, stream: str = "ingests") -> None:
    """Run a stream of ingests until its input is used up."""
    handle = lambda rows, batch: apply_ingests(analyses, figures, rows, batch, stream)
    ingests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
