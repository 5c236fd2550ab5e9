"""Scalar functions as Column builders."""
