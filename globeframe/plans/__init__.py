"""The registered queries: importing the package fills ``catalogue.QUERIES``."""

from . import building, catalogue, forms, nearest, polygons, steps, surface  # noqa: F401
