"""Streaming entry points.

The reference has no stream processing; its uploads are cleaned file by
file. ``ingest.clean_uploads`` expresses that flow as a Structured
Streaming job over an upload folder, reusing the batch operators.
"""
