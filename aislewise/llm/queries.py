"""Queries of the training-data operators, opN_<name>, and the SQL of those that SQL can express."""

from . import bpe, fim, langid, packing, pattern_packing, quality, quotes, radix_dedup, reputation, simhash, warc, whitening, wordpiece

_MODULES = (quotes, wordpiece, langid, warc, reputation, simhash, bpe, quality, packing, radix_dedup, fim, whitening, pattern_packing)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {"op4_warc_revisits": warc.SQL, "op5_url_reputation": reputation.SQL, "op10_exact_dedup": radix_dedup.SQL, "op11_lookaround_fim": fim.SQL}
