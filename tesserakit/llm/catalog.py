"""Modules with queries of this subpackage."""

from __future__ import annotations

from . import fill_queries, neardup_queries, neighbour_queries, scan_queries, sentence_queries, split_queries

MODULES = [split_queries, neardup_queries, neighbour_queries, fill_queries, sentence_queries, scan_queries]
