"""Library-circulation operators: ``(tables, inputs, as_of, ...) -> DataFrame(s)``."""
