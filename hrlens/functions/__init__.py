"""Column -> Column expressions: text cleaners, string parsers, exact rounding, dates."""
