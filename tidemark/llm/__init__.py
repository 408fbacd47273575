"""Training-data operators over a documents table (doc_id, text, lang, source, n_chars)."""
