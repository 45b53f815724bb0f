"""codeweave: code-evidence analytics as PySpark DataFrame jobs."""
