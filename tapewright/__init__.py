"""tapewright: point-in-time market-data operators for PySpark."""
