"""Operators: ``f(df, ...) -> DataFrame``, lazy, nothing collected."""
