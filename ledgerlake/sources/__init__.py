"""Readers and writers of the change log's external forms."""
