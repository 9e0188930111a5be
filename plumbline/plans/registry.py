"""All queries of the library but those of the training-data operators."""

from plumbline.plans import bench_queries, check_queries, claim_queries, claim_table_queries, code_queries, crash_queries, evidence_queries, extraction_queries, history_queries, join_queries, lookup_queries, report_queries, scope_queries, source_queries, text_queries, trace_queries

MODULES = (evidence_queries, text_queries, join_queries, claim_queries, extraction_queries, trace_queries, check_queries, source_queries, code_queries, crash_queries, report_queries, lookup_queries, history_queries, scope_queries, claim_table_queries, bench_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
