"""Feeds: an extension that keeps the catalogue up to date as captures arrive."""
