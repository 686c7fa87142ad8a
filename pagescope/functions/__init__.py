"""Functions on values: logical types, statistics, bloom lookups, sizes for people."""
