"""From query text to one predicate over the catalog."""
