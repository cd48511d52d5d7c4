"""Operators for text corpora: quality, near-duplicates, decontamination, secrets,
personal data, tokenizing, language, toxicity and quoted mail. Nothing else in
the library imports this folder.

All of them take whole tables and whole texts, read ``spark.checkpoint.dir`` for
the tables they write on the way, and count a null text as an empty one.
"""
