"""Structured Streaming: bars, sessions and stateful tiers."""
