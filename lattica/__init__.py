"""lattica: k-means and quantization on metric spaces, expressed as Spark plans."""

__version__ = "0.1.0"
