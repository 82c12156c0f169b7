"""Column functions: predicates on cell text, conversions that return errors as data, spans and times."""
