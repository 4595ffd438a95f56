"""flightops.streaming: 12-hour windows (ST-1) and de-duplicating incremental ingest (ST-2)."""
