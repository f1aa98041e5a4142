"""Training-data operators: DataFrame in, DataFrame out, one module per operator.

Nothing outside this folder imports it.  ``queries`` binds the operators to the
driver tables.
"""
