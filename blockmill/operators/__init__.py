"""Block state: time to live, eviction, clock, merge, metrics."""
