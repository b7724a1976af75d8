"""Flows made of operators, and the named pipeline around them."""
