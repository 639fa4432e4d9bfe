"""engramlake: a PySpark engine for curated text memory.

Batch operators take and return DataFrames; nothing here starts an action unless
its docstring says so.
"""

__version__ = "0.1.0"
