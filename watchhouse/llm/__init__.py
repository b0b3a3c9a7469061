"""Training-data operators: quality scoring, rules, sharding, packing, search, de-duplication, extraction, encoding.

Each module holds one operator with its own interface; ``queries`` registers one query per operator.
"""
