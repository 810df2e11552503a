"""Input tables, published lists, staged tables and the result history."""
