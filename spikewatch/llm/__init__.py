"""Operations of a training-data pipeline over the ``documents`` and
``embeddings`` tables.  Nothing else in the library imports this subpackage."""
