"""Structured Streaming wrappers of the operators, and stateful operators with batch twins."""
