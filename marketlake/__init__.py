"""marketlake: equity market data as Spark batch and streaming jobs."""
