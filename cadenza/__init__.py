"""Cadenza: timed-transcript, lifecycle and engagement analytics on Spark."""
