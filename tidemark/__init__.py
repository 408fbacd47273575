"""tidemark: fishery monitoring and survey analytics as Spark DataFrame plans.

Operators take DataFrames and return lazy DataFrames. Nothing here collects
rows to the driver, reads the clock, or relies on row position.
"""

__version__ = "0.1.0"
