"""Inputs and outputs: the TESTDATA star adapter, the derived catalog, change
messages built from tables, Kafka/JSON message streams, CSV catalogs, JDBC
snapshots, Parquet sinks and the versioned (latest-per-key) table view."""
