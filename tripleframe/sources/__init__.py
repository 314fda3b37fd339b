"""Readers and writers of corpora, runs, templates and knowledge-base tables."""
