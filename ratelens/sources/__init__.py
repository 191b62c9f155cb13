"""Readers: observation history, snapshot feeds, nested payloads, sheets."""
