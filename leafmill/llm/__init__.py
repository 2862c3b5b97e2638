"""Operators that prepare text corpora for language models; nothing outside this folder imports it."""
