"""Named queries: operators wired to tables, each with its check SQL."""
