"""Column functions: text, entities, statistics."""
