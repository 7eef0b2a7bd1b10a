"""Volumes, candidates, trajectories, meshes and rasters as Spark DataFrames."""
