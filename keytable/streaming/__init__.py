"""Change streams applied in micro-batches."""
