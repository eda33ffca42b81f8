"""Incremental segmentation of arriving traces."""
