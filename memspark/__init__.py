"""memspark: retrieval, classification, capture and telemetry analytics over project records, as Spark jobs."""
