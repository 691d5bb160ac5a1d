"""Streaming of paneltide."""
