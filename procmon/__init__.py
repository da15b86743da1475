"""procmon: predictive process monitoring on Spark DataFrames.

Event logs are ordinary DataFrames; the roles of their columns are given by a
:class:`~procmon.spec.LogSpec`.  Every operator takes and returns DataFrames
and is built from Spark SQL built-ins, window functions, joins and MLlib.
"""

from procmon.spec import LogSpec

__all__ = ["LogSpec"]
