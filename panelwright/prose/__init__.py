"""Wording and structure checks on documents held in tables: text to blocks, blocks to findings."""
