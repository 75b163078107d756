"""Named queries over the test tables, each with the ANSI SQL that must give the same rows.

The tables stand in for the pair index by shape: ``documents`` for the index, ``labels`` for its partial
statistics, ``events`` for run logs, ``part`` and ``lineitem`` for catalogues, ``embeddings`` for rasters
and keypoints. Results are rounded to six digits where their last bits depend on the order of summation.
"""

from __future__ import annotations

from pairset.plans.catalogue import curation, detection, evaluation, raster, runlog, sampling, tables

_AREAS = (curation, sampling, evaluation, runlog, raster, detection, tables)


def queries() -> dict:
    return {name: fn for area in _AREAS for name, fn in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in _AREAS for name, sql in area.ORACLES.items()}
