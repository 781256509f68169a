"""Batch and streaming web-data jobs as plain functions over Spark DataFrames."""
