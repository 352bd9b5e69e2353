"""Readers and writers: tables, payload JSON, HTML pages, OCR results."""
