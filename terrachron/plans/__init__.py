"""Registered queries: `catalog` for the operators, `edges` for the outer layer, which adds its own to the same registry."""
