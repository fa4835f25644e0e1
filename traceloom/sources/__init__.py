"""Readers and writers: summaries, sources, tabular jobs, event logs and reports."""
