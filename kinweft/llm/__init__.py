"""Training-data operators for very large text corpora.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds its queries when
it is present.  Every operator takes DataFrames, returns DataFrames, and keeps its intermediate
tables in the shared folder of the session (see :mod:`kinweft.llm.shared`).
"""
