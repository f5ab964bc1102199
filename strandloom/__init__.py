"""Strandloom: assembly-repair analytics expressed as Spark DataFrames."""
