"""Systems-evidence analytics on PySpark: fact graphs, traces, text scans, event streams."""
