"""Readers: Parquet tables, trees of source files, lines, dependency manifests."""
