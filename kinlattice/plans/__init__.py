"""Declarative specs, plan-shape helpers and the registered queries."""
