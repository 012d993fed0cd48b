"""Candle tables: bars out of ticks, landing files, partitioned Parquet, JDBC."""
