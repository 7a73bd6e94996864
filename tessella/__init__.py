"""Entity-table analytics on Spark: event logs, column families, stitching, versions, metrics."""
