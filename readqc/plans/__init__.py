"""The metric programs: each builds lazy tables from inputs and options."""
