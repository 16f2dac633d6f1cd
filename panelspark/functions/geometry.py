"""Plane and sphere geometry as column expressions."""

from pyspark.sql import Column, functions as F

# Earth radius and acre, in feet.
EARTH_RADIUS_FT = 3958.8 * 5280
SQ_FT_PER_ACRE = 43560
MILLION = 10 ** 6


def squared_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return dx * dx + dy * dy


def strip_area(lat: Column, res_x, res_y, n_cells: Column) -> Column:
    """Area in square feet of `n_cells` cells in one latitude row of a sphere."""
    half = res_y / 2.0
    height = F.abs(F.sin(F.radians(lat - half)) - F.sin(F.radians(lat + half)))
    return F.radians(res_x * n_cells) * F.lit(EARTH_RADIUS_FT ** 2) * height


def million_acre_feet(cubic_feet: Column) -> Column:
    return cubic_feet / MILLION / SQ_FT_PER_ACRE
