"""Batch operators over packet, alert and technique tables."""
