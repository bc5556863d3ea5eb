"""DataFrame operators.  Every function takes DataFrames (plus column names
and parameters) and returns a DataFrame; nothing collects raw rows."""
