"""What the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.shared import BATCH, CLEANUP, Scratch, broadcast_if_small, new_path, settings, shared_dir, written

__all__ = ["BATCH", "CLEANUP", "Scratch", "broadcast_if_small", "new_path", "settings", "shared_dir", "text_of", "written"]


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
