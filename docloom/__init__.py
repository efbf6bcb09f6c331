"""DocLoom: document-corpus analytics on Spark."""
