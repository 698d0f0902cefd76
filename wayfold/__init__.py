"""Wayfold: road-network analytics on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames; nothing in the
package opens a path except the readers in ``wayfold.sources``.
"""
