"""Advice on statements: schema catalog, facts, index candidates and rules. Plain Python, no Spark."""
