"""Streaming forms of stateful stages."""
