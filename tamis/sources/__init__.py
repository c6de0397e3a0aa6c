"""Readers: file trees, tables of texts, rules, policies, diffs, feeds."""
