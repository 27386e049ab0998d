"""Scans and sinks. Each ``read_*`` names a path; each ``parse_*`` takes rows already read."""
