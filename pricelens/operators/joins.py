"""Joins of the panel with labels, coordinates and reference lists.

Sizes: labels and coordinates have one row per entity; reference lists are
short.  None of them is hinted blindly: ``broadcast_checked`` proves the
bound first, otherwise the planner (with AQE's runtime statistics) chooses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_checked


def attach_clusters(df: DataFrame, labels: DataFrame, entity: str = "City", cluster: str = "Cluster") -> DataFrame:
    """Panel LEFT JOIN labels on the entity (NULL cluster when unlabeled)."""
    lb = labels.select(entity, cluster)
    return df.join(broadcast_checked(lb), entity, "left")


def attach_coordinates(entities: DataFrame, coords: DataFrame, entity: str = "City") -> DataFrame:
    """Entities LEFT JOIN coordinates; unknown entities get NULL lat/lon."""
    c = coords.select(entity, "Latitude", "Longitude")
    return entities.join(broadcast_checked(c), entity, "left")


def map_points(labels: DataFrame, coords: DataFrame, entity: str = "City", cluster: str = "Cluster") -> DataFrame:
    """Distinct (entity, cluster) INNER JOIN coordinates."""
    c = coords.select(entity, "Latitude", "Longitude")
    return labels.select(entity, cluster).distinct().join(broadcast_checked(c), entity, "inner")


def unknown_keys(df: DataFrame, ref: DataFrame | Sequence[str], key: str = "City") -> DataFrame:
    """Distinct values of ``key`` absent from the reference list."""
    if not isinstance(ref, DataFrame):
        ref = df.sparkSession.createDataFrame([(str(v),) for v in ref], f"`{key}` string")
    r = ref.select(F.col(ref.columns[0]).alias(key)).distinct()
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(broadcast_checked(r), key, "left_anti")


def dense_grid(facts: DataFrame, base: DataFrame, dims: dict[str, Sequence], keys: Sequence[str]) -> DataFrame:
    """Every row of ``base`` (e.g. item x cluster pairs) times every
    combination of the small literal dimensions ``dims`` (e.g. years, months),
    LEFT JOIN the facts on ``keys``; absent cells are NULL.  The literal
    dimensions are exploded, so no cartesian join is planned."""
    g = base
    for name, values in dims.items():
        g = g.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return g.join(facts, list(keys), "left")
