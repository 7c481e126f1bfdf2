"""Structured Streaming: facts that replace each other, takes that land in a folder, and tries of stages."""
