"""Column expressions: geometry measures, planning symbols, keys and text parsing."""
