"""Streams of gradient entries."""
