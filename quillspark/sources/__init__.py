"""Readers and writers: raw texts, lake layouts, receipts, control files, downloads."""
