"""A PySpark engine for alignment-free deduplication of sequencing reads."""
