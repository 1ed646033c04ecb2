"""Operators of a training-data pipeline over text tables.

Each module holds one operator. Operators take DataFrames, read only the
columns they name (other columns may have any name) and return DataFrames;
intermediate tables go to the shared checkpoint folder.
"""
