"""Folio: datasets assembled from collections of per-entity objects, in Spark terms."""

__version__ = "0.1.0"
