"""Operators for training-data pipelines. Of the rest of the library only ``operators.ngrams`` and ``operators.overlap`` import from it: the joins of ``near_dup`` and ``split_overlap``, and ``vec``."""
