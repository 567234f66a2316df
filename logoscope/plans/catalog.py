"""All queries on the reference operators; importing this module registers them."""

from __future__ import annotations

from logoscope.plans import detection, streams, tenants, texts  # noqa: F401
from logoscope.plans.registry import ORACLES, QUERIES  # noqa: F401
