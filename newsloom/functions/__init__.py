"""Column expressions and small task-side helpers shared by the operators."""
