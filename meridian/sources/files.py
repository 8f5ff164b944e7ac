"""Whole-file formats by name. Schemas come from headers; the work is dealt by files or by ranges inside them."""

from __future__ import annotations

from .netcdf import NetCDF, netcdf
from .registry import Registry
from .shapes import RESERVED, read_dbf, read_shapes, shapefile
from .tables import FF10_NUMERIC, FF10_POINT, csv_points, ff10, json_points, select_members
from .tiff import geotiff, read_tiff

__all__ = ["FF10_NUMERIC", "FF10_POINT", "FORMATS", "NetCDF", "RESERVED", "csv_points", "ff10", "geotiff", "json_points", "netcdf", "read_dbf", "read_shapes", "read_tiff", "select_members", "shapefile"]

FORMATS = Registry("format", netcdf=netcdf, geotiff=geotiff, shapefile=shapefile, ff10=ff10, csv=csv_points, json=json_points)
