"""possum: point-of-sale analytics on PySpark.

Raw extracts to typed tables (``plans.etl``), key checks
(``operators.checks``), the buyers-per-product view (``plans.views``), nested
documents (``plans.documents``) and their reports (``plans.reports``), change
logs (``plans.changes``) and their streaming upkeep (``streaming``), sinks and
atomic publishing (``sources.sinks``). Entry points: ``plans.jobs``.
"""

__version__ = "0.1.0"
