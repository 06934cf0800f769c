"""Column-expression helpers (built-in Spark functions only)."""

from ratingspark.functions import arrays, hashing, text

__all__ = ["arrays", "hashing", "text"]
