"""Structured Streaming forms of the stateful operators (extensions: the batch forms are the contract)."""
