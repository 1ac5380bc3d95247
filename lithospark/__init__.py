"""Spark jobs for geostatistical tables: points, drill holes, grids and stratigraphic meshes."""
