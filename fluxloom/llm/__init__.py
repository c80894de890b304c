"""Training-data operators: formatting, media, near-duplicates, tokens, HTML, toxicity, leaks, WARC.

Nothing outside this folder imports it. ``queries`` lists the registered queries.
"""
