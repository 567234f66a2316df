"""A folder that driver and executors share, for what a job writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid


def scratch(spark, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset, under a local folder on one machine (as in tests),
    and elsewhere an error, as executors would write to their own disks and readers would miss rows."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='logoscope-')}"
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
