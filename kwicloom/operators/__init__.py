"""Operators on concordances. Importing the package registers every algorithm."""

from . import annotate, cluster, label, partition, rank, select, sort  # noqa: F401
