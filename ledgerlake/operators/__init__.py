"""DataFrame-in, DataFrame-out operators. Keys default to ``entity_id``."""
