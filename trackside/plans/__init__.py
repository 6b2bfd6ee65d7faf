"""Composed plans: registered queries, their oracle SQL, and season jobs."""
