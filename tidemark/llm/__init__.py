"""Training-data operators: media columns, tokenisation, packing, dedup, PII, HTML and quality.

Each operator lives in its own module; ``queries.py`` holds the thin ``opN_*`` queries.
"""
