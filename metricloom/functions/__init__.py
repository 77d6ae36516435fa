"""Column-level functions: text, numbers, dates, arrays and distribution tails."""
