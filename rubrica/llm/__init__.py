"""Operators for training-data pipelines: near and exact duplicates, packing, scoring, scans."""
