"""Causal event histories as DataFrames: identity, order, reduction, replication and projections."""
