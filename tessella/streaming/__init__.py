"""Live metric series as Structured Streaming."""
