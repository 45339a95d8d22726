"""Column expressions: text, vectors, schedules."""
