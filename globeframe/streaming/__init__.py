"""Streams against static regions."""
