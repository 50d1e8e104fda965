"""Scalar functions of the reference as Spark column expressions."""
