"""flightops.plans."""
