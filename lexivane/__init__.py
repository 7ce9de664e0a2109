"""Corpus analytics on Spark: document signals, corpus snapshots, drift alerts, detector evaluation and simulation."""
