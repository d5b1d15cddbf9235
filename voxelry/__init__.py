"""Sparse voxel analytics on Spark DataFrames."""
