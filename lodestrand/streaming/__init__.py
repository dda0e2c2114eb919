"""Streams of file events: debouncing, the work queue, polls."""
