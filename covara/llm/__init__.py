"""Operators for large training corpora: quality, deduplication, decontamination, scoring, scans and mixing.

Nothing outside this subpackage imports it.
"""
