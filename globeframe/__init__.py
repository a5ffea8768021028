"""globeframe: geometry on the sphere as PySpark columns, joins and aggregations."""

__version__ = "0.1.0"
