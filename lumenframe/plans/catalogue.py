"""All core queries, gathered from the modules of this subpackage."""

from __future__ import annotations

from . import corpus, ingest, models, quality, relations, spatial, spectra, texts  # noqa: F401
from .registry import QUERIES, SQL, Query

FLAGSHIP = "mutual_knn_j06"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
