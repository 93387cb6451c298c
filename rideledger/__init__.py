"""Ride analytics on Spark: batch tables, streams and read-side marts."""
