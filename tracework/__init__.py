"""Analytics on sampled signals and other ordered numeric series, on PySpark."""
