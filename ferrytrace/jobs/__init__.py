"""Whole jobs for spark-submit: read, select, deliver, measure."""
