"""Importing any module of this package registers the queries of all."""

from . import directories, layouts, queries, searches, storage, streams  # noqa: F401
