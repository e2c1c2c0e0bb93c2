"""All registered queries of the engine and their SQL."""

from . import execution, lifecycle, many, notes, planning, queries, records, upkeep

QUERIES = queries.QUERIES | planning.QUERIES | upkeep.QUERIES | records.QUERIES | notes.QUERIES | execution.QUERIES | lifecycle.QUERIES | many.QUERIES
SQL = queries.SQL | planning.SQL | upkeep.SQL | records.SQL | notes.SQL | execution.SQL | lifecycle.SQL | many.SQL
