"""All queries of the domain, and their SQL."""

from . import assembly, detection, evaluation, rasters, reports, site

_PARTS = (detection, evaluation, assembly, site, reports, rasters)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
SQL = {k: v for part in _PARTS for k, v in part.SQL.items()}
