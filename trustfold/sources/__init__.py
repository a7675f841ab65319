"""Readers and writers for labelled rows, histories, logs and models."""
