"""Operators as functions over dense voxel tables: one module per family."""
