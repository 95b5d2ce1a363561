"""Training-data operators: tokenising, archives, extraction, deduplication, scoring, packing, sharding.

Each module holds one operator; ``queries`` registers the thin ``opN_<name>`` queries on top of them.
Nothing outside this subpackage imports it.
"""
