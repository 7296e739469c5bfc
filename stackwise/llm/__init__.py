"""Training-data operators: filtering, de-duplication, decontamination, packing and sharding of text corpora.

Nothing else in the library imports this subpackage; it imports only general helpers
(:mod:`stackwise.session`).
"""
