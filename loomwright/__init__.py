"""loomwright: set-at-a-time retrieval, graph and evaluation analytics on PySpark."""
