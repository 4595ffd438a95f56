"""flightops.sources."""
