"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from marlstone.llm import alignment, ann, bpe, fingerprints, langid, licenses, mixing, pii, resampling, secrets, simhash, topk, warc

MODULES = [simhash, warc, licenses, ann, langid, bpe, secrets, topk, mixing, pii, alignment, fingerprints, resampling]

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
