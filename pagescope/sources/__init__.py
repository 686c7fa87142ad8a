"""Where bytes come from: listings by Spark, ranges of files by executors, dumps."""
