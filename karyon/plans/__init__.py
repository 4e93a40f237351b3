"""Plan helpers: shared workspace, range joins, distributed ranks."""
