"""A PySpark engine for place lookups in batch, and tools around them."""
