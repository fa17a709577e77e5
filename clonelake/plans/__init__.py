"""Registered queries: DataFrame plans over the tables of a data folder, with their SQL twins."""
