"""Hierarchy and recall analytics as DataFrame-to-DataFrame functions on Spark."""
