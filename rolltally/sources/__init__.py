"""Readers, benchmark adapters, sinks and output layout."""
