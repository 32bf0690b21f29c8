"""Detectors: each takes the facts of a corpus and returns hits."""
