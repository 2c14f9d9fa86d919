"""depotlens: warehouse-operations analytics as Spark DataFrame jobs.

Reports live in ``depotlens.plans``, snapshot/refresh and join helpers in
``depotlens.operators``, the change-data apply in ``depotlens.streaming``.
"""
