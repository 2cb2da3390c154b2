"""Benchmarks: YAML definitions, discovery, generated data, timed runs, JSON reports."""
