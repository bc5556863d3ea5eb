"""Readers and writers: Parquet tables, survey CSVs, JSON lookup maps,
GeoJSON feature collections, positional binding and CSV/Parquet sinks."""
