"""Structured Streaming forms of discovery, verification and triage."""
