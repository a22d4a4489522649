"""Tidewatch: data quality, profiling and pipeline monitoring as Spark jobs."""
