"""Perturbation-matrix analytics on PySpark: labelled sparse count matrices as DataFrames."""

from pertmatrix.matrix import CONTROL, CountMatrix

__all__ = ["CONTROL", "CountMatrix"]
