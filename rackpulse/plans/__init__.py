"""Query registry (name -> report call with the fixture parameters) and DuckDB oracle SQL."""
