"""Logical plans: predicates and queries over declared entities."""
