"""The queries of the engine and their SQL, by key."""

from __future__ import annotations

from assaya.operators import behavior, coherence, digest, impact, intent, ledger, policy, provenance, ranking, relational, review, shown, text, wording
from assaya.sources import corpus, repository, state

QUERIES = behavior.QUERIES | text.QUERIES | relational.QUERIES | ledger.QUERIES | wording.QUERIES | review.QUERIES | policy.QUERIES | ranking.QUERIES | impact.QUERIES | coherence.QUERIES | digest.QUERIES | provenance.QUERIES | state.QUERIES | corpus.QUERIES | intent.QUERIES | shown.QUERIES | repository.QUERIES
ORACLE_SQL = behavior.ORACLE_SQL | text.ORACLE_SQL | relational.ORACLE_SQL | ledger.ORACLE_SQL | wording.ORACLE_SQL | review.ORACLE_SQL | policy.ORACLE_SQL | ranking.ORACLE_SQL | impact.ORACLE_SQL | coherence.ORACLE_SQL | digest.ORACLE_SQL | provenance.ORACLE_SQL | state.ORACLE_SQL | corpus.ORACLE_SQL | intent.ORACLE_SQL | shown.ORACLE_SQL | repository.ORACLE_SQL
