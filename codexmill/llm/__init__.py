"""Training-data operators: thirteen corpus operators and their queries.

Nothing outside this subpackage imports it, save the guarded registration in
``__spark_entry__`` and ``corpus_pipeline`` at the repository top.
"""
