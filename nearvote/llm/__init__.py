"""Training-data operators: packing, deduplication, decontamination, scans, formatting, token files.

Nothing else in the library imports this subpackage.
"""
