"""Operators over papers, contexts, people, passages and findings."""
