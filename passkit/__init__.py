"""passkit: large-scale evaluation of code-generation samples on Spark.

Problems, samples, results and measurements are DataFrames; every operator
is a DataFrame -> DataFrame function built from Spark SQL expressions, so
Catalyst prunes, pushes down and codegens the whole plan.
"""

__version__ = "0.1.0"
