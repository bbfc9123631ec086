"""Reading listings, the snapshot table, and the JSON exchange format."""
