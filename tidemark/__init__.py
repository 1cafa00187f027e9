"""Tidemark: message-stream analytics and sketches on PySpark."""
