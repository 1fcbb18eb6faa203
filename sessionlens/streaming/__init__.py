"""Growing logs as Structured Streaming queries."""
