"""Similarity analytics on Spark: DataFrame-first operators over items, vectors, trees and events."""
