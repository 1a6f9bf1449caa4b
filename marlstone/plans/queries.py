"""Every query of the engine by name, and its oracle where SQL has one."""

from marlstone.plans import code_queries, corpus_queries, io_queries, score_queries, stage_queries

MODULES = [score_queries, corpus_queries, stage_queries, code_queries, io_queries]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
