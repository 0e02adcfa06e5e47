"""Checks, watch rules, risk levels, back-tests, playbooks and decisions."""
