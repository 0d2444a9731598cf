"""Column expressions (no DataFrame in, Column out): estimator, text, extraction, equality, prompts, model rules."""
