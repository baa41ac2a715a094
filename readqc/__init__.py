"""Sequencing quality control on Spark DataFrames."""
