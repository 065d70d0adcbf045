"""From clauses to DataFrame plans, and the catalogue of queries."""
