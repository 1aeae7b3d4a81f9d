"""Maintenance of all tables, in the order in which it is safe."""

from __future__ import annotations

import time

from fleetlake.plans.jobs import EXPIRE_DAYS, ORPHAN_DAYS
from fleetlake.schemas import TABLES
from fleetlake.sources.table import Catalog

DAY_MS = 86_400_000
ORDER = ["compact", "checkpoint-log", "verify", "expire", "remove-orphans"]


def run(catalog: Catalog, step: str | None = None, dry_run: bool = False, now_ms: int | None = None) -> dict[str, dict[str, object]]:
    """All steps, or one, over all tables that exist; what each did by step and table."""
    if step is not None and step not in ORDER:
        raise ValueError(f"unknown step {step!r}")
    now, out = now_ms or int(time.time() * 1000), {}
    for one in [step] if step else ORDER:
        out[one] = {}
        for name in TABLES:
            table = catalog.table(name)
            if table.current_id() is None:
                continue
            if one == "compact":
                done = table.compact()
                out[one][name] = done and done.summary["rewritten-data-files"]
            elif one == "checkpoint-log":
                done = table.checkpoint_log()
                out[one][name] = done and done.version
            elif one == "verify":
                total = sum(f.rows for f in table._live(table._last().version))
                if table.read().count() != total:
                    raise RuntimeError(f"{name} doesn't hold the rows that its log tells")
                out[one][name] = total
            elif one == "expire":
                out[one][name] = 0 if dry_run else table.expire(now - EXPIRE_DAYS * DAY_MS)
            else:
                out[one][name] = table.remove_orphans(now - ORPHAN_DAYS * DAY_MS, dry_run)
    return out
