"""Daily interim monitoring as a Structured Streaming job."""
