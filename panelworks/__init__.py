"""Batch jobs over monthly loan panels and text corpora, written for Spark."""
