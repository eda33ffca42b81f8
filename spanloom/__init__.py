"""Segmentation of long texts into labelled spans, and analysis of the spans, on Spark."""
