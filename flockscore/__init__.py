"""Bot scoring of social media accounts as Spark DataFrame jobs.

Start points: ``flockscore.plans.score`` (batch profiles), ``flockscore.operators``
(single indicators), ``flockscore.plans.reports`` / ``texts`` (reports),
``flockscore.sources`` (reading and writing) and ``flockscore.streaming``.
"""
