"""Streams of landed documents."""
