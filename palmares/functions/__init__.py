"""Column expressions: recoding, scalar helpers and bins. All stay inside whole-stage code generation."""
