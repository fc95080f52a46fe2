"""tablelens: automated exploratory analysis, cleaning and masking on Spark."""

__version__ = "0.1.0"
