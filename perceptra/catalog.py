"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from .plans import detection, evaluation, formats, grids, histograms, learning, primitives, rays3d, worlds  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
