"""Ready-made queries over the benchmark tables, each with a SQL counterpart."""
