"""Operators of paneltide."""
