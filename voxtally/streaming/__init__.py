"""Incremental versions of the batch scans."""
