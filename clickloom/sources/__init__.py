"""Readers, writers, state tables and the test-table adapter."""
