"""nichelab: species-distribution analytics as plain Spark DataFrame jobs.

Occurrence records -> quality filters -> raster cell joins -> temporal
features -> model-ready tables -> boosted-tree training and evaluation ->
scored grids and risk analytics.  Everything is DataFrame / SQL / MLlib;
no Python UDFs run in the hot path.
"""

__version__ = "0.1.0"
