"""pairsignals: pair-signal analytics (cointegration test and spread z-score
over all pairs of daily series) as Spark DataFrame jobs.

Entry points: ``pairsignals.plans.analysis`` (pair statistics, verdicts and
signals), ``pairsignals.plans.ingest`` / ``pairsignals.plans.nightly``
(loading and refresh), ``pairsignals.operators.store`` (keyed tables).
"""

__version__ = "0.1.0"
