"""Queries of the market-analytics operators and the SQL that gives the same rows."""

from __future__ import annotations

from ..operators import accounts, actions, boards, cleaning, episodes, events, evidence, gates, models, more, scoring, tables, targets, trailing
from ..sources import stores
from ..streaming import jobs
from . import sql

FLAGSHIP = "entry_board_ranking"
QUERIES = {name: plan.frame for name, plan in trailing.PLANS.items()}
ORACLE_SQL = {name: plan.oracle() for name, plan in trailing.PLANS.items()}
for _module in (boards, cleaning, evidence, accounts, actions, episodes, gates, more, models, scoring, tables, targets, stores):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE
QUERIES |= events.QUERIES | jobs.QUERIES
ORACLE_SQL |= {name: text for name, text in jobs.ORACLE.items() if text}
ORACLE_SQL = {n: sql.with_(sql.BARS).rstrip() + " " + t.removeprefix("BARS:") if t.startswith("BARS:") else t for n, t in ORACLE_SQL.items()}
