"""The document pipeline: clean, chunk, dedupe, keyword and vector search, fusion."""
