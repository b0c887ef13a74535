"""Whole jobs: raw counts to a cleaned, imputed dataset in two parts, and the graph tables of a sensor set."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.fills import hour_mean
from sensorloom.operators.grid import filter_missing_rate, keep_sensors, regular_grid, time_range, with_mask
from sensorloom.operators.outliers import Step, absolute_limit, chain, zeros_beside_gaps
from sensorloom.operators.roadnet import bounded_distances, gaussian_adjacency, largest_components, link_locations, link_metadata
from sensorloom.plans.scratch import written, written_by

#: The limit of an hourly count, and the last hour of the training part.
HOURLY_LIMIT, TRAIN_END = 3450, "2025-11-30 23:59:59"


def make_subset(
    traffic: DataFrame,
    start: str | None = None,
    end: str | None = None,
    cut: str = TRAIN_END,
    targets: DataFrame | None = None,
    adjacency: DataFrame | None = None,
    sensors: DataFrame | None = None,
    cluster_count: int | None = None,
    missing_rate: float = 0.9,
    outliers: Iterable[Step] = (),
    fills: Iterable[Step] | None = None,
) -> dict[str, DataFrame]:
    """``full, train, test`` values and their masks (``*_missing``).

    Masks are taken after the outlier steps and before imputation. The training part is imputed alone, so it
    never sees test hours; the test part comes from the imputation of the whole series.
    """
    rows = keep_sensors(traffic, targets) if targets is not None else traffic
    if cluster_count and adjacency is not None and sensors is not None:
        rows = keep_sensors(rows, largest_components(adjacency, sensors, rows.select("sensor_id").distinct(), cluster_count))
    rows = filter_missing_rate(time_range(regular_grid(rows), start, end), missing_rate)
    # Bucketed by sensor, so that no fill of the whole or of the training part shuffles again.
    rows = written_by(chain(rows, [absolute_limit(HOURLY_LIMIT), zeros_beside_gaps(), *outliers]), "sensor_id", dealt=True)
    fills = [hour_mean()] if fills is None else list(fills)
    mask = with_mask(rows).select("sensor_id", "ts", "is_missing")
    full, train = chain(rows, fills), chain(time_range(rows, end=cut), fills)
    return {"full": full, "train": train, "test": time_range(full, start=cut), "full_missing": mask, "train_missing": time_range(mask, end=cut), "test_missing": time_range(mask, start=cut)}


def make_graph(sensors: DataFrame, links: DataFrame, edges: DataFrame, limit: float = 9000, least: float = 0.1) -> dict[str, DataFrame]:
    """``sensors, metadata, locations, distances, adjacency`` of a sensor set."""
    ids = sensors.select("idx", "sensor_id")
    distances = written(bounded_distances(edges, ids, limit, links))
    locations = link_locations(links).join(ids.select("sensor_id"), "sensor_id", "left_semi")
    metadata = links if {"ROAD_NAME"} <= set(links.columns) else links.withColumns({c: F.lit(None).cast("string") for c in ("ROAD_NAME", "ROAD_RANK", "ROAD_TYPE", "REST_VEH")})
    return {"sensors": ids, "metadata": link_metadata(metadata, ids)[0], "locations": locations, "distances": distances, "adjacency": gaussian_adjacency(distances, ids, least, unique=True)}
