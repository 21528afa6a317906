"""quillgrid: document retrieval, evaluation and training-data operators as PySpark DataFrame functions."""
