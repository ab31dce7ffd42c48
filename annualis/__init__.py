"""annualis: retrieval, phrase extraction and evaluation over filing text as Spark DataFrame operators.

Every operator takes and returns DataFrames (or Columns).  Nothing is collected to the
driver inside an operator; small dimension tables (patterns, segments, questions) are
built from fixed values in :mod:`annualis.config` and broadcast behind a size check.
"""

__version__ = "0.1.0"
