"""Table cleaning, profiling, comparison and cleaning-log analytics as Spark jobs."""
