"""quillspark: document-evidence analytics and training-data preparation on PySpark."""
