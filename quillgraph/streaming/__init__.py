"""Event-log jobs on Structured Streaming and their batch counterparts."""
