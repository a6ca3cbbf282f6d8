"""quillspark: document-accessibility and corpus analytics as ordinary Spark jobs."""
