"""Queries over the given tables, one per operator or report, each with its SQL counterpart where there is one."""
