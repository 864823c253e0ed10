"""Mesh and point-cloud operators over DataFrames."""
