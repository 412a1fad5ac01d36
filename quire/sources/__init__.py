"""Inputs: page text, figures, tables and outlines as structured rows, plus deterministic seeded projections."""
