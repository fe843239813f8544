"""All queries and SQL of the core library."""

from __future__ import annotations

from ampmill.plans import models, observed, power, problems, reports, search, texts

QUERIES = {**models.QUERIES, **observed.QUERIES, **power.QUERIES, **problems.QUERIES, **reports.QUERIES, **search.QUERIES, **texts.QUERIES}
SQL = {**models.SQL, **observed.SQL, **power.SQL, **problems.SQL, **reports.SQL, **search.SQL, **texts.SQL}
