"""Corpus hygiene analytics on Spark: facts, rules, graph, clones, scores and reports."""
