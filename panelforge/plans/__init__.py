"""Registered queries: one per operator, each with its SQL twin where SQL can say it."""
