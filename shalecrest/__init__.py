"""shalecrest: retrieval indexing, search, evaluation and telemetry analytics as Spark plans."""
