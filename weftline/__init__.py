"""Weftline: lineage and liveness analysis of semantic models on PySpark."""
