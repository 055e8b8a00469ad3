"""Operations for large-scale training-data preparation.

One module per operator; nothing outside this subpackage (and
``corpus_pipeline.py``) imports it.
"""
