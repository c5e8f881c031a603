"""barloom: a Spark-native engine for price-bar strategy research."""

__version__ = "0.1.0"
