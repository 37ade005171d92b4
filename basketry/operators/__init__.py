"""DataFrame operators of the library (all lazy; no driver collects)."""
