"""Geospatial attribution, geography rollups, manifest planning and catalogs as Spark DataFrame operators."""
