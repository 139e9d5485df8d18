"""Rows of any type: values that carry their own types, and the operators over them."""
