"""Training-data operators: text extraction, tokenisation, search, mixing,
scanning, filtering, archiving and near-duplicate joins as Spark jobs.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and their cross-check SQL.
"""
