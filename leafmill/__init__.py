"""Leafmill: document, page, edit-log and site-corpus analytics on Spark."""
