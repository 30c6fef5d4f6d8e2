"""Batch and streaming jobs for event-result data, as DataFrame programs."""
