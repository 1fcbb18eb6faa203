"""Column expressions and small Arrow functions used inside the jobs."""
