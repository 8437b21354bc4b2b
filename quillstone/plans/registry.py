"""All registered queries outside the training-data part."""

from quillstone.plans import eval_queries, learn_queries, report_queries, retrieval_queries, text_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (text_queries, eval_queries, retrieval_queries, learn_queries, report_queries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
