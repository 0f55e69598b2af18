"""Queries by name, each with its comparison SQL if there is one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalume.operators.filters import effective_decision, join_decisions, with_trash_state
from catalume.plans.adapters import table, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SEEN = """seen as (
    select p.*, case when c.path is not null then c.decision else d.decision end as decision, c.path is not null as has_override,
        l.state as trash_state, l.from_path as original_path, l.trashed_at as trashed_at
    from photos p left join decisions d on d.hash = p.content_hash
    left join copies c on c.hash = p.content_hash and c.path = p.path
    left join (select trash_path, arg_max(state, id) as state, arg_max(from_path, id) as from_path, arg_max(trashed_at, id) as trashed_at
        from ledger where state in ('trashed', 'emptied', 'missing') group by trash_path) l on l.trash_path = p.path)"""


class Tables:
    """The catalog tables of a folder, by attribute; ``seen`` are photos with decision and trash state."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def seen(self) -> DataFrame:
        return with_trash_state(effective_decision(self.photos, self.decisions, self.copies), self.ledger)

    @property
    def joined(self) -> DataFrame:
        return join_decisions(self.photos, self.decisions, self.copies)


def query(sql: str | None = None) -> Callable:
    """Registers a function of ``Tables`` under its name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            text = sql.strip()
            if re.search(r"\bseen\b", text):
                m = re.match(r"with\s+(recursive\s+)?", text, re.I)
                text = f"with {m[1] or ''}{SEEN}, {text[m.end():]}" if m else f"with {SEEN} {text}"
            SQL[f.__name__] = with_clause(text)
        return f

    return add
