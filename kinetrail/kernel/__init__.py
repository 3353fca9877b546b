"""Geometry behind an adapter: programs are parsed, never executed; solids are analytic."""
