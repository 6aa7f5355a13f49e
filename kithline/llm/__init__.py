"""Training-data operators.  Nothing outside this subpackage imports it.

Every operator takes and returns DataFrames, selects its own columns first (extra
columns of any name are ignored) and states its edge cases in its docstring.
"""
