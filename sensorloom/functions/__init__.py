"""Column functions that the operators share, for use in one's own queries."""

from sensorloom.operators.grid import hours_between, missing_as_null
from sensorloom.operators.roadnet import line_length, web_mercator, wkt_point
from sensorloom.operators.samples import day_of_week, time_of_day
from sensorloom.operators.scores import mae, rmse, smape, wmape

__all__ = ["day_of_week", "hours_between", "line_length", "mae", "missing_as_null", "rmse", "smape", "time_of_day", "web_mercator", "wkt_point", "wmape"]
