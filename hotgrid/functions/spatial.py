"""Column functions on coordinates and lattice cells."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from hotgrid import settings as S


def cell_of(lat: Column, lon: Column) -> Column:
    """Nearest lattice node of a position in degrees (one rounding per axis)."""
    i = F.floor((lat - S.LAT_MIN) * S.NODES_PER_DEG_LAT + 0.5)
    j = F.floor((lon - S.LON_MIN) * S.NODES_PER_DEG_LON + 0.5)
    return _clamped_cell(i, j)


def cell_of_e6(lat_e6: Column, lon_e6: Column) -> Column:
    """Same as :func:`cell_of` for integer micro-degrees, in exact integer arithmetic."""
    lat0, lon0 = int(S.LAT_MIN * 1_000_000), int(S.LON_MIN * 1_000_000)
    million = F.lit(1_000_000).cast("bigint")

    def nearest(offset: Column) -> Column:
        return F.call_function("div", offset - F.pmod(offset, million), million)

    i = nearest((lat_e6 - lat0).cast("bigint") * S.NODES_PER_DEG_LAT + 500_000)
    j = nearest((lon_e6 - lon0).cast("bigint") * S.NODES_PER_DEG_LON + 500_000)
    return _clamped_cell(i, j)


def _clamped_cell(i: Column, j: Column) -> Column:
    i = F.least(F.greatest(i, F.lit(0)), F.lit(S.N_LAT - 1))
    j = F.least(F.greatest(j, F.lit(0)), F.lit(S.N_LON - 1))
    return (i * S.N_LON + j).cast("bigint")


def cell_row(cell: Column) -> Column:
    return F.floor(cell / S.N_LON).cast("bigint")


def cell_col(cell: Column) -> Column:
    return (cell % S.N_LON).cast("bigint")


def cell_lat(cell: Column) -> Column:
    return F.lit(S.LAT_MIN) + cell_row(cell) / F.lit(float(S.NODES_PER_DEG_LAT))


def cell_lon(cell: Column) -> Column:
    return F.lit(S.LON_MIN) + cell_col(cell) / F.lit(float(S.NODES_PER_DEG_LON))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6371 km."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), 2)
    return F.lit(2 * S.EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
