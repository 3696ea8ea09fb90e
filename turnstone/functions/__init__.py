"""Part of turnstone."""
