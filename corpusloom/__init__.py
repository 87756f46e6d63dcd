"""Corpus analytics on Spark: corpus sampling, tokenising, rendering, packing, windowing and evaluation metrics."""
