"""Tidemark: point-in-time equity research jobs on Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame.  Nothing here runs an
action except the sinks and the streaming batch writers.
"""

__version__ = "0.1.0"
