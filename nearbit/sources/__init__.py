"""Readers, writers and generators of bit-string sets."""
