"""Series sources, run scans and result sinks."""
