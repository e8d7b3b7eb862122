"""Operators for preparing large text corpora. Nothing else imports this package."""
