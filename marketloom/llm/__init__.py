"""Operations of a training-data pipeline, one module for each operator.

The modules stand alone: nothing else in the package imports them.
"""
