"""rackpulse: unattended-retail rack analytics as lazy Spark DataFrame operators.

Layout
  sources/    logical-table catalog, snapshot and paid filters, sinks, test-table adapter
  functions/  column-expression helpers (day/month keys, headcount parsing, bands, safe ratios)
  operators/  the business reports, one ``DataFrame -> DataFrame`` function each
  plans/      the query registry (name -> report call with its parameters) and the DuckDB oracle SQL
"""

from rackpulse.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
