"""quarry: set-at-a-time retrieval, re-ranking and retrieval evaluation on Spark.

Every operator is a ``DataFrame -> DataFrame`` function keyed by ``question_id``.
Operators declare plans only (no actions) unless their docstring says otherwise.
"""

__version__ = "0.1.0"
