"""Structured Streaming front-ends of the stateful operators."""
