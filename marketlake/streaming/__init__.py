"""Structured Streaming jobs: the CDC micro-batch pipeline with live report
refresh and month roll-ups."""
