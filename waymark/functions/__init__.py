"""Column functions: positions, times, texts, aggregates."""
