"""marlstone: deterministic text and document analytics as Spark DataFrame operators."""
