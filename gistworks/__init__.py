"""Extractive-summary building and evaluation over article corpora, on Spark."""
