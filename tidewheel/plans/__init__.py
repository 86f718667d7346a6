"""SQL twins of the registered queries, for checks by another engine."""
