"""Bytes of Parquet files: Thrift records, schema trees, pages, encodings, codecs, bloom filters. No Spark here."""
