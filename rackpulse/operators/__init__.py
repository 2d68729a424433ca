"""Business reports. Each takes a ``Catalog`` plus parameters and returns a lazy DataFrame."""
