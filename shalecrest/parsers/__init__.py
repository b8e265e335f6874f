"""Documents to nodes: a row for each node in the order of reading, instead of a tree."""
