"""Operations of a training-data pipeline over document, conversation and vector tables.

Each module holds one operator with a general interface; ``registry`` holds the
queries over the driver's tables. Nothing else in the library imports this
subpackage.
"""
