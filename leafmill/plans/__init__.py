"""Registered queries; importing this package fills the registry."""

from leafmill.plans import documents, layout, records, redaction, site, streams

__all__ = ["documents", "layout", "records", "redaction", "site", "streams"]
