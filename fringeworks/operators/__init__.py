"""Relational and array operators over the data model of `schema`."""
