"""All queries of the delivery engine and their SQL."""

from __future__ import annotations

from waybill.plans import delivery, documents, scalars, workflow

PARTS = (delivery, documents, workflow, scalars)
QUERIES = {k: f for part in PARTS for k, f in part.QUERIES.items()}
SQL = {k: s for part in PARTS for k, s in part.SQL.items()}
