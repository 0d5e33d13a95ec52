"""Scalar functions: columns wherever Spark has the operations, NumPy behind Arrow where it hasn't."""
