"""Structured Streaming form of the credibility rule."""
