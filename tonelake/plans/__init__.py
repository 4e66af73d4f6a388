"""Queries of the library over the tables in TESTDATA.md, each with SQL for DuckDB."""
