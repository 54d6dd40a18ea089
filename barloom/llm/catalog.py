"""All queries of the subpackage; importing the modules registers them."""
from barloom.llm import (  # noqa: F401
    queries_lines, queries_minhash, queries_packing, queries_periodic, queries_resampling, queries_rules, queries_search, queries_sharding, queries_simhash, queries_substring, queries_tokens, queries_trie)
from barloom.llm.registry import ORACLES, QUERIES  # noqa: F401
