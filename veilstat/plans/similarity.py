"""From document metrics to clusters, neighbours and prototypes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat import lexicons as lx
from veilstat.operators.learn import N_CLUSTERS, cluster, feature_points
from veilstat.operators.neighbors import neighbor_report, prototype_report
from veilstat.session import cut_lineage


def clustered_points(
    metrics: DataFrame,
    key: str = "name",
    wanted: Sequence[str] = lx.FEATURES,
    k: int = N_CLUSTERS,
    restarts: int = 20,
    digits: int | None = None,
) -> DataFrame:
    """(key, point, cluster_label), written once for the reports that follow.

    Equal texts have sums that were added in different orders; rounded to
    ``digits``, they have equal points, and of equals the least key is named.
    """
    points = feature_points(metrics, key, wanted)
    if digits is not None:
        points = points.withColumn("point", F.transform("point", lambda x: F.round(x + 1e-9, digits) + 0.0))
    return cut_lineage(cluster(points, "point", k, restarts, key=key))


def similarity_reports(
    metrics: DataFrame,
    key: str = "name",
    k: int = N_CLUSTERS,
    restarts: int = 20,
    digits: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Neighbours of every document, and the prototype of every cluster."""
    points = clustered_points(metrics, key, k=k, restarts=restarts, digits=digits)
    return (
        neighbor_report(points, key, "point", "cluster_label"),
        prototype_report(points, key, "point", "cluster_label"),
    )
