"""Readers, stores and exporters."""
