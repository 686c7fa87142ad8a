"""Relations under names: for SQL and for the command line."""
