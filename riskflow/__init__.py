"""riskflow: geospatial risk analytics as Spark DataFrame and Spark ML operators.

Sub-packages:
    sources    readers, file fingerprint, sinks
    functions  column expressions (geo, calendar, levels, hashing) and exact quantiles
    operators  profiling, preparation, models, isolation forest, evaluation, risk, chart tables
    plans      derived frames, end-to-end jobs, the query catalogue
    streaming  file-stream scoring
"""

from riskflow.params import Params

__all__ = ["Params"]
