"""Queries over the driver tables, by family; importing the package registers them."""

from . import blocks, distributions, evaluate, learning, measures, prediction, roads, routes, sequences, synthesis  # noqa: F401
