"""Analytics on Spark for fused operational feeds, and operators for training corpora."""
