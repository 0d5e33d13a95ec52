"""Registered queries and whole-dataflow plans."""
