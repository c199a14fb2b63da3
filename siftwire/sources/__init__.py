"""Connectors: raw JSON, XML and CSV text as items and client snapshots.

Each takes a table of raw answers, a row for each request, so that how they were fetched (HTTP, a landing
folder) doesn't matter. An answer that can't be read gives no rows.
"""
