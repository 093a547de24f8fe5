"""Statistics over event-time windows, in batch and in Structured Streaming."""
