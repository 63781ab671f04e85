"""Training-data operators: thirteen corpus operators and the pipeline built on them.

Nothing outside this subpackage imports it.
"""
