"""The derived tables the reports build and read back (the source's drop + create-as-select chain)."""

from __future__ import annotations

from rackpulse.operators import companies, users
from rackpulse.sources.catalog import Catalog
from rackpulse.sources.sinks import materialise

# logical name of each derived table -> how it is computed
DERIVED = {
    "headcount_length": lambda cat, as_of: companies.headcount_length(cat),
    "headcount_parsed": lambda cat, as_of: companies.headcount_parsed(cat),
    "small_companies": lambda cat, as_of: companies.small_companies(cat, as_of),
    "weekly_cohort": lambda cat, as_of: users.weekly_cohort(cat),
    "company_band": lambda cat, as_of: companies.company_band(cat, as_of),
}


def rebuild_derived_tables(cat: Catalog, as_of: str, root: str | None = None,
                           names=tuple(DERIVED)) -> dict[str, str]:
    """Overwrite each derived table under ``root`` (default: the shared ``spark.checkpoint.dir``);
    rerunning gives the same tables. Returns name -> path. Reports that reuse one of them (for
    example ``repeat_rate`` on the weekly cohort) can read it back instead of recomputing it."""
    return {n: materialise(DERIVED[n](cat, as_of), n, root) for n in names}
