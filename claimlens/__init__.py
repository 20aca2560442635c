"""Claim verification over tables and streams of claims, on Spark."""
