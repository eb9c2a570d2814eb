"""Operators for preparing training data. Nothing else imports this subpackage."""
