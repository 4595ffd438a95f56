"""flightops.operators."""
