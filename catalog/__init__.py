"""Registered queries: every operator on the shared test tables, with the same result in plain SQL."""
