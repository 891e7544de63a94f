"""Tidemark: message-stream analytics on PySpark DataFrames.

Every row is a message with a source position and an acknowledgement status.
The package only builds logical plans; Catalyst chooses how they run.
"""

__version__ = "0.1.0"
