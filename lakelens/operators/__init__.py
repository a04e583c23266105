"""Declarative operators: DataFrame in, lazy DataFrame out."""
