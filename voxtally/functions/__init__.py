"""Column-level building blocks: every one returns a ``Column`` usable anywhere."""
