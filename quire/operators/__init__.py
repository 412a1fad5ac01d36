"""Review operators: every public function maps DataFrames (or Columns) to DataFrames (or Columns)."""
